"""Golden cases of the operators, and every query against its SQL."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadloom.functions import text as X
from leadloom.operators import audit, events, evidence, facets, pages, qualify, select, study
from leadloom.plans import catalogue
from leadloom.sources import tables
from leadloom.streaming import changes as stream

SF = "/root/testdata/sf0.001"


def day(s):
    return dt.date.fromisoformat(s)


def value(spark, column, **named):
    row = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in named.items()])
    return row.select(column.alias("x")).first().x


def test_prefix_match(spark):
    assert value(spark, X.prefix_match("c", ("771",)), c="77") is True
    assert value(spark, X.prefix_match("c", ("771",)), c="78") is False
    assert value(spark, X.prefix_match("c", ("771",), "pass"), c="") is True
    assert value(spark, X.prefix_match("c", ("771",), "unknown"), c="") is None


@pytest.mark.parametrize(
    "quote, found",
    [
        ("Firma vyrábí díly", "Firma vyrábí díly"), ("„Firma vyrábí díly“", "Firma vyrábí díly"), ("Firma vyrábí díly...", "Firma vyrábí díly"), ("Firma vyrábí díly.", "Firma vyrábí díly"),
        ("firma VYRÁBÍ díly", "Firma vyrábí díly"), ("Firma ... na zakázku", None), ("Firma prodává", None), ("", None), (None, None),
    ],
)
def test_find_quote(spark, quote, found):
    assert value(spark, X.find_quote(F.col("q"), F.col("t")), q=quote, t="Zde:\xa0 Firma   vyrábí\ndíly, na zakázku") == found


def test_text_functions(spark):
    assert value(spark, X.normalise("t"), t=" a\xa0\n b ") == "a b"
    assert value(spark, X.fold("t"), t="Žluťoučký KŮŇ") == "zlutoucky kun"
    assert [value(spark, X.company_key("t"), t=t) for t in ("123", "00000000", "123456789", "")] == ["00000123", None, "123456789", None]
    assert [value(spark, X.occupation_group("t"), t=t) for t in ("CzIsco/13210", "13210")] == ["1321", "1321"]
    assert value(spark, X.parse_day("t"), t="do 3. 9. 2024 12:00") == day("2024-09-03")
    assert value(spark, X.parse_day("t"), t="bez data") is None
    assert value(spark, X.serial_day("t"), t="45292") == day("2024-01-01")
    assert value(spark, X.serial_day("t"), t="0") is None
    assert value(spark, X.iso_day("t", "2000-01-01", "2024-01-31"), t="2024-02-01T00:00") is None
    assert value(spark, X.iso_day("t"), t="x") is None


def test_radius_has_a_tolerance(spark):
    firms = spark.createDataFrame([("a", 152.0), ("b", 156.0), ("c", None)], "ico string, km double")
    brief = qualify.Brief(origin=(50.0, 15.0), km=150.0)
    got = {r.ico: r.r for r in firms.select("ico", qualify.reject_reason(brief).alias("r")).collect()}
    assert got == {"a": None, "b": "outside_radius", "c": "location_unknown"}


def test_liquidation_is_read_off_the_name(spark):
    rows = spark.createDataFrame([("A v likvidaci", False, 0, 0), ("likvidace lomů", False, 2, 0), ("B", True, 2, 1)], "name string, insolvent boolean, sites_total int, sites_active int")
    got = [r.v for r in rows.select(qualify.verdict(qualify.negative_findings()).alias("v")).collect()]
    assert got == ["exclude", "deprioritise", "exclude"]


def moves(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, ico string, kind string, name string, date date")


def test_mass_and_founding_guards(spark):
    rows = moves(spark, [("a", "director_joined", "x", day("2024-01-20")), ("a", "director_joined", "y", day("2024-01-20")), ("b", "owner_joined", "z", day("2024-01-20")), ("c", "owner_joined", "z", day("2024-01-20"))])
    firms = spark.createDataFrame([("a", day("2000-01-01")), ("b", day("2023-06-01")), ("c", day("2001-01-01"))], "ico string, founded date")
    assert [r.ico for r in events.registry_events(rows, firms, "2024-01-31", 30).collect()] == ["c"]


def test_reentries(spark):
    rows = moves(spark, [("a", "director_joined", "x", day("2024-01-20")), ("a", "director_departed", "x", day("2024-01-22")), ("a", "director_departed", "Y", day("2024-01-22")), ("a", "owner_departed", "Y", day("2024-01-22"))])
    listed = spark.createDataFrame([("a", "director", "y")], "ico string, role string, name string")
    assert [r.kind for r in events.drop_reentries(rows, listed).collect()] == ["owner_departed"]


def test_reason_classes(spark):
    rows = [("a", "subsidy_signed", 5), ("b", "director_joined", 3), ("c", "tender_open", 0), ("d", "management_vacancy", 9), ("e", "subsidy_signed", 7)]
    tenders = spark.createDataFrame([("c", True), ("e", True), ("a", False)], "ico string, relevant boolean")
    got = events.reasons(spark.createDataFrame(rows, "ico string, kind string, age_days int"), tenders).collect()
    assert {r.ico: (r.reason, r.age_days) for r in got} == {"a": ("A", 5), "b": ("B", 3), "c": ("C", 0), "d": ("D", 9), "e": ("E", 7)}


def test_exact_rank_percentile(spark):
    rows = spark.range(1000).select(F.date_sub(F.lit("2024-01-31").cast("date"), F.col("id").cast("int")).alias("d"))
    assert study.rank_percentile(rows, "d", "2024-01-31").first().lag == 10


def test_absence_and_counter_evidence(spark):
    rows = spark.createDataFrame(
        [("pain:x", "není zmínka o tom, informace chybí", None), ("pain:x", "není zmínka", "quote"), ("pain:scale", "v", "Jednosměnný provoz"), ("pain:tacit_knowledge", "v", "Zaučení zkušeným kolegou"), ("pain:tacit_knowledge", "v", "PO ZAUČENÍ postup na pozici zástupce")],
        "kind string, value string, quote string",
    ).withColumn("relevance", F.lit(None).cast("string"))
    assert [r.x for r in rows.select(evidence.counts().alias("x")).collect()] == [False, True, False, False, True]


def test_one_row_per_quote(spark):
    rows = [(1, "a", "pain", "v", "Stejná věta.", 1, None), (2, "a", "pain:scale", "w", "stejná  věta", 2, None), (3, "a", "pain:scale", "w", "jiná", 1, None)]
    claims = spark.createDataFrame(rows, "claim_id long, ico string, kind string, value string, quote string, run_id int, relevance string")
    assert [r.claim_id for r in evidence.usable(claims).collect()] == [2]


def test_quota_keeps_a_slot(spark):
    rows = spark.createDataFrame([(f"b{i}", "B", i) for i in range(1, 7)] + [("d", "D", 7)], "ico string, reason string, place int")
    got = {r.ico: r.class_slot for r in select.quota(rows, 5).collect()}
    assert got == {"b1": False, "b2": False, "b3": False, "b4": False, "d": True}


def test_collapse_keeps_siblings(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("w", 4)], "ico string, place int")
    owned = spark.createDataFrame([(i, "Holding", day("2024-01-05")) for i in "xyz"], "ico string, owner string, date date")
    got = {r.ico: r.siblings for r in select.collapse(rows, owned).collect()}
    assert got == {"x": ["y", "z"], "w": []}


def test_already_shown(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ico string")
    happened = spark.createDataFrame([("a", "x", day("2024-01-10")), ("b", "x", day("2024-01-11")), ("c", "tender_open", None)], "ico string, kind string, date date")
    sent = spark.createDataFrame([(i, day("2024-01-10")) for i in "abc"], "ico string, delivered_on date")
    assert sorted(r.ico for r in select.not_shown(rows, happened, sent).collect()) == ["b", "c", "d"]


def test_contested_domain(spark):
    rows = spark.createDataFrame([("a", "x.cz", "name", "proven"), ("b", "x.cz", "person", "proven"), ("c", "x.cz", "ico", "proven"), ("d", "y.cz", "name", "proven")], "ico string, domain string, evidence string, status string")
    assert {r.ico: r.status for r in facets.contested(rows).collect()} == {"a": "probable", "b": "probable", "c": "proven", "d": "proven"}


def test_register_round_trip(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿" + ",".join(tables.REGISTER_COLUMNS) + "\n" + ",".join(["1", "Firma", "", "77"] + [""] * 9) + "\n", encoding="utf-8")
    row = tables.read_register(spark, str(path)).first()
    assert (row.ICO, row.KATPO, row.NACE) == ("1", None, "77")
    with pytest.raises(ValueError):
        tables.read_register(spark, str(path), ("NOPE",))
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"ico": "1", "n": 1}\n{"ico": "2", "error": "x"}\n{"ico": "3", "n"')
    assert [r.ico for r in tables.read_lines(spark, str(lines), "ico string, n int").collect()] == ["1"]


def test_tables(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "ico string, seq int, v string")
    assert sorted((r.ico, r.v) for r in tables.last_wins(rows, ["ico"], ["seq"]).collect()) == [("a", "y"), ("b", "z")]
    new = spark.createDataFrame([("a", 9, "n"), ("q", 9, "n")], rows.schema)
    assert sorted((r.ico, r.v) for r in tables.upsert(rows.where("seq = 1"), new, "ico").collect()) == [("a", "n"), ("b", "z")]
    assert [r.ico for r in tables.resume(rows, new, "ico").collect()] == ["b"]
    with pytest.raises(ValueError):
        tables.require(rows, 4)


def test_page_text_and_desks(spark):
    assert value(spark, pages.page_text(F.col("h")), h="<p>A&nbsp;&amp; b<script>x</script><!-- y --> c</p>") == "A & b c"
    got = [value(spark, pages.desk_rank(F.col("a")), a=a) for a in ("obchod@x.cz", "info@x.cz", "jan@x.cz", "efaktury@x.cz")]
    assert got == [0, 1, 2, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = catalogue.T.change(spark, SF)
    folder, base = tmp_path / "in", tmp_path / "base"
    rows.repartition(4).write.parquet(str(folder))
    rows.limit(50).write.mode("append").parquet(str(folder))  # batches that come again
    versions = []

    def read_base():
        return spark.read.parquet(versions[-1]) if versions else None

    def write_base(df, number):
        df.write.parquet(f"{base}/v{number}")
        versions.append(f"{base}/v{number}")

    source = stream.once_each(stream.read_batches(spark, str(folder), rows.schema, 2), ["ico", "batch", "pos"])
    q = stream.merge_into(source, read_base, write_base).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, read_base().collect())) == sorted(map(tuple, stream.last_in_batch(rows).collect()))
    flagged = stream.flag_uncovered(rows, "2024-01-03").groupBy("uncovered").count().collect()
    assert {r.uncovered for r in flagged} == {True, False}


def test_page_changes_stream_equals_batch(spark, tmp_path):
    """Two micro-batches against the batch index: null urls compare with any url, rows go by fetched_at, then id."""
    told = [("u", "x"), ("u", "x"), (None, "x"), ("v", "y"), (None, "y"), ("u", "y"), (None, "z"), ("v", "y"), (None, "z")]
    rows = [("a", "web", url, 50 - i if i < 2 else i, day("2024-01-01") + dt.timedelta(days=i // 2), text) for i, (url, text) in enumerate(told)]
    texts = spark.createDataFrame([*rows, ("b", "web", None, 90, day("2024-01-01"), "q")], "ico string, source string, url string, id long, fetched_at date, text string")
    want = sorted((r.id, r.changed) for r in tables.store_snapshots(texts)[0].select("id", "changed").collect())
    hashed = texts.withColumn("sha256", X.digest("text")).drop("text")
    spark.conf.set(*stream.STATE_STORE)
    first = hashed.where("fetched_at < date'2024-01-03'")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    source = spark.readStream.schema(hashed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = lambda: stream.page_changes(source).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    start()
    hashed.where("fetched_at >= date'2024-01-03'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    spark.conf.unset(stream.STATE_STORE[0])
    assert sorted((r.id, r.changed) for r in got) == want


def test_statement_rows(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<v><r c="1" b="10" m="8"/><r c="2" b="5" m=""/><r c="9" b="1" m="1"/></v>')
    rows = tables.read_statement(spark, str(tmp_path / "s.xml"), "r", "c", "b", "m").withColumn("ico", F.lit("a")).withColumn("year", F.lit(2023))
    assert tuple(tables.statement_totals(rows).first()) == ("a", 2023, 15000, 8000)


def test_audit_finds_violations(spark):
    rows = spark.createDataFrame([("a",), ("a",)], "ico string")
    assert audit.distinct_companies({"week": rows}).count() == 1


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)[:19].removesuffix(" 00:00:00") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
