"""Long cells, wide spans, long labelled texts and clashing names change nothing but themselves."""

import random
import re
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from leadloom.llm import html_text, toxicity


def words(text):
    return sorted(w for w in text.split() if w != "|")


@pytest.mark.parametrize("cell", ["x" * 200_000, "word " * 40_000])
def test_long_cell_doesnt_widen_other_rows(cell):
    page = "<table>" + f"<tr><td>{cell}<td>b" + "<tr><td>a<td>b" * 1000 + "</table>"
    text = html_text.extract(page)[1]
    assert len(text) <= 20 * len(page)
    assert words(text) == sorted([*cell.split(), *["b"] * 1001, *["a"] * 1000])
    assert re.search(r"\na {70,80}\| b$", text.rstrip("\n"))


def test_wide_and_tall_spans_take_little_time():
    cell = "<td colspan=1000 rowspan=65534>y"
    for page in ("<table>" + f"<tr>{cell}" * 2000, "<table><tr>" + "<td rowspan=65534>z" * 1700 + "<tr><td>q" * 3500, "<table>" + ("<tr>" + cell * 3) * 600):
        start = time.time()
        text = html_text.extract(page)[1]
        assert time.time() - start < 1.5 and len(text) <= 20 * len(page)
        assert words(text) == sorted(page.replace(cell, " y ").replace("<td rowspan=65534>z", " z ").replace("<td>q", " q ").replace("<tr>", "").replace("<table>", "").split())


def test_spans_keep_their_columns():
    """Rows against a grid that is filled cell by cell."""
    pick = random.Random(4)
    for _ in range(300):
        rows = [[(pick.randint(1, 3), pick.choice([0, 1, 1, 2, 3]), [str(k)]) for k in range(pick.randint(0, 3))] for _ in range(pick.randint(1, 5))]
        taken, want = {}, []
        for r, row in enumerate(rows):
            at, own = 0, []
            for wide, tall, lines in row:
                while (r, at) in taken:
                    at += 1
                own.append((at, at + wide, lines))
                for y in range(r, len(rows) if tall == 0 else min(len(rows), r + tall)):
                    taken.update({(y, x): 1 for x in range(at, at + wide)})
                at += wide
            want.append(own)
        assert list(html_text._columns(rows)) == want


def test_lines_are_broken_at_blanks_only():
    assert html_text._broken("aa bb cc", 5) == ["aa bb", "cc"]
    assert html_text._broken("aaaaaaaa bb", 5) == ["aaaaaaaa", "bb"]
    assert html_text._broken("aaaaaaaaa", 5) == ["aaaaaaaaa"]


def test_a_long_labelled_text_leaves_out_itself_only(spark):
    rows = [(i, f"plain words number {i} stand here" + (" vilemark" if i % 2 else ""), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    for i in range(100, 106):
        long = spark.createDataFrame([(i, "calm " * 1000)], docs.schema)
        model = toxicity.train(docs.unionByName(long), labels.unionByName(spark.createDataFrame([(i, 0)], labels.schema)), F.lit(True), max_chars=4_000)
        assert model == toxicity.train(docs, labels, F.lit(True), max_chars=4_000) and model.weights
    with pytest.raises(ValueError):
        toxicity.train(docs, labels, F.lit(True), max_chars=3)


def test_toxicity_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a vilemark b", 5, "x"), (1, None, None, None)], "doc_id long, text string, toxicity int, y string").withColumns({c: F.lit(0) for c in ("k", "hash", "chars")})
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert toxicity.tag_documents(docs, model).columns == ["doc_id", "text", "y", "k", "hash", "chars", "toxicity", "toxic_spans"]


def test_one_of_each_with_clashing_names(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    names = ("count", "wins", "parts", "best", "size", "key", "id", "n", "label")
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a), (None, b), (3, None)], "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (3, None)], key=str)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0
