"""Quotes of one and two words against documents of any company: as a comparison of all pairs."""

from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators import evidence

QUOTES = ["zakázku", "„zakázku“", "Zakázku...", "kus", "na", "a", "na zakázku.", "„Vyrábí díly“", "rábí dí", "díly, na…", "nic takového", "xyz", "„Firma vyrábí díly“", "ábí díly na", "“", "a b", "", None]
TEXTS = ["Firma vyrábí díly, na zakázku.", "Kusová výroba", "firma vyrábí\ndíly na zakázku", ""]


def test_short_quotes_equal_all_pairs(spark):
    findings = spark.createDataFrame(list(enumerate(QUOTES)), "finding_id int, quote string")
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.finding_id: (r.state, r.matched, r.snapshot_id if r.state == "fact" else None) for r in evidence.verify_quotes(findings, documents).collect()}
    pairs = findings.crossJoin(documents).withColumn("m", X.find_quote(F.col("quote"), F.col("text"))).where("m is not null")
    hits = {r.finding_id: r.b for r in pairs.groupBy("finding_id").agg(F.min(F.struct("id", "m")).alias("b")).collect()}
    assert got == {i: ("fact", hits[i].m, hits[i].id) if i in hits else ("discard" if q else "inference", None, None) for i, q in enumerate(QUOTES)}
    assert sum(s == "fact" for s, _, _ in got.values()) >= 12
