"""Queries over texts read all of each text."""

from leadloom.operators import identity
from leadloom.plans import identity_queries

SF = "/root/testdata/sf0.001"


def test_unit_scale_reads_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(identity, "unit_scale", lambda texts, pattern: texts)
    got = {r.id: r.text for r in identity_queries.unit_scale(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert all(got[r.doc_id].endswith(r.text) for r in docs) and max(len(r.text) for r in docs) > 20
