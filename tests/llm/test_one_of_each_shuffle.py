"""The texts that one_of_each shuffles are those of rows that go, not of all that stay."""

import pytest
from pyspark.sql import functions as F
from test_near_dup import brute, planted

from leadloom.llm import joins, near_dup


def shuffled_texts(df):
    """Rows with a text that the executed plan of ``df`` sent through a shuffle."""

    def nodes(node):
        yield node
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        for x in below:
            yield from nodes(x)

    def has_text(node):
        return any(node.output().apply(i).name() == "text" for i in range(node.output().size()))

    found = [x for x in nodes(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "ShuffleExchangeExec" and has_text(x)]
    return sum(x.metrics().apply("shuffleRecordsWritten").value() for x in found)


@pytest.fixture
def large(spark):
    """No table is small enough for Spark to broadcast it by itself, as on a large input."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("repeated", [False, True])
def test_rows_that_stay_are_not_shuffled_with_their_texts(large, repeated):
    rows = [(i, " ".join(f"v{i}w{j}" for j in range(12))) for i in range(1000)] + [(2000 + i, " ".join(f"v{i}w{j}" for j in range(12))) for i in range(50)]
    more = [(-1, "a row of its own here"), (-1, "and another of that same id")] if repeated else []
    df = near_dup.one_of_each(large.createDataFrame(rows + more, "doc_id long, text string"))
    assert sorted(df.collect()) == sorted(rows[:1000] + more)
    assert shuffled_texts(df) < 50 + 1000 / 8 + 2 * len(more)


def test_texts_of_many_classes_are_found_without_a_broadcast(large, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST_KEYS", 5)
    rows = planted(90, seed=31)
    df = large.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("most", [joins.MOST_BITS, joins.ROW_BITS])
def test_lists_of_keys(large, monkeypatch, most):
    """Exact with several rows of bits and with a bitmap that is too small for its keys; null is a key like others."""
    monkeypatch.setattr(joins, "MOST_BITS", most)
    rows = large.range(20_000).select(F.when(F.col("id") < 9, None).otherwise(F.col("id") * 7919 - 70_000_000).alias("k"), "id")
    listed = rows.where("id % 4 = 1").select(F.col("k").alias("key")).distinct()
    assert listed.where("key is null").count() == 1
    for keys, ids in ((listed, {*range(9), *range(1, 20_000, 4)}), (listed.where("key is not null"), set(range(9, 20_000, 4))), (listed.limit(0), set())):
        flagged = {r.id for r in joins.maybe_among(rows, F.col("k"), keys).where("__maybe").collect()}
        assert flagged >= ids
        assert most == joins.ROW_BITS or len(flagged - ids) < 20_000 / joins.BITS_PER_KEY
        assert {r.id for r in joins.among(rows, F.col("k"), keys).collect()} == ids
        assert {r.id for r in joins.without(rows, F.col("k"), keys).collect()} == set(range(20_000)) - ids
