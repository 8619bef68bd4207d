"""Recording, folding, versions, register answers, sheets, page bodies, vacancy documents and coverage."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from leadloom.functions import folding
from leadloom.operators import evidence, pages, recording
from leadloom.plans import catalogue as C
from leadloom.plans import record_queries as Q
from leadloom.sources import payloads, sheets, versions
from leadloom.streaming import changes as stream

NAMES = ["q124_evidence_anchor", "q125_record_events", "q126_recorded_claims", "q128_versioned_upsert", "q129_sheet_rows", "q130_register_answers", "q132_vacancy_documents", "q133_coverage"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "part", "events", "supplier", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = C.QUERIES[name](spark, SF)
    found = con.execute(C.SQL[name])
    order = [c[0] for c in found.description]
    clean = lambda v: "" if v is None else f"{float(v):.9g}" if type(v).__name__ in ("float", "Decimal") else str(v)
    want = sorted(tuple(map(clean, r)) for r in found.fetchall())
    got = sorted(tuple(clean(r[c]) for c in order) for r in frame.collect())
    assert got == want and len(got) > 0 and sorted(order) == sorted(frame.columns)


def plain_quote(event, text):
    """The rule as a plain reader: the date, then the name behind it; else the name."""
    last = event["name"].split()[-1] if event["name"] and event["name"].split() else None
    if last and event["date"]:
        for at in range(len(text)):
            if text.startswith(f'"{event["date"]}"', at) and last in text[at : at + 1200]:
                field = text.rfind('"datum', max(0, at - 40), at)
                end = text.index(last, at) + len(last)
                return text[field if field >= 0 else at : end + 90]
    for anchor in [f'"prijmeni": "{last}"', last] if last else []:
        if anchor in text:
            at = text.index(anchor)
            return text[max(0, at - 320) : at + len(anchor) + 90]
    return None


def test_register_quotes_equal_a_plain_reader(spark):
    pick = random.Random(11)
    rows = []
    for i in range(150):
        text = "".join(pick.choice(['"datumZapisu": "2024-01-0%d"' % pick.randint(1, 3), "😀" * pick.randint(0, 30), "ž" * pick.choice([5, 300, 1150, 1300]), '"prijmeni": "Ký[1]"', "Ký[1]", '"2024-01-02"', ' "datum']) for _ in range(pick.randint(0, 14)))
        rows.append((i, "director_joined", f"2024-01-0{pick.randint(1, 3)}", pick.choice(["Jan  Ký[1] ", "Jan Jiný", "", None, "Ký[1]"]), text))
    table = spark.createDataFrame(rows, "i int, kind string, date string, name string, text string").withColumns({c: F.lit(None).cast("string") for c in ("subject", "project", "title", "isco")})
    got = {r.i: r.quote for r in table.select("i", recording.evidence_quote(F.col("text")).alias("quote")).collect()}
    want = {r[0]: plain_quote({"date": r[2], "name": r[3]}, r[4]) for r in rows}
    assert got == want and sum(v is not None for v in want.values()) > 40


def test_other_kinds_go_by_their_own_words(spark):
    text = "x" * 400 + "Stavba haly a skladu" + "y" * 200
    rows = [("tender_open", "Stavba haly", None, None, None), ("subsidy_signed", None, "Stavba haly a skladu", None, None), ("management_vacancy", None, None, "", "haly"), ("tender_open", "", None, None, None), ("tender_open", "STAVBA HÁLY", None, None, None)]
    table = spark.createDataFrame(rows, "kind string, subject string, project string, title string, isco string").withColumn("date", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string"))
    plain = [r.q for r in table.select(recording.evidence_quote(F.lit(text)).alias("q")).collect()]
    assert plain == [text[80 : 411 + 90], text[80 : 420 + 90], text[87 : 411 + 90], None, None]
    folded = [r.q for r in table.select(recording.evidence_quote(F.lit(text), folded=True).alias("q")).collect()]
    assert folded == plain[:4] + [text[80 : 411 + 90]]


def test_folding_keeps_the_way_back(spark):
    texts = ["Žluťoučký KŮŇ", "éá x", "İstanbul ŞİŞLİ", "ﬁ Ǆ ß", "Ελλάδα", "", None, "ascii", "각 간", "à́b"]
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in table.select("i", folding.fold_exact("t").alias("f")).collect()}
    assert all(got[i] is None if t is None else unicodedata.normalize("NFC", got[i]) == unicodedata.normalize("NFC", strip(t)) for i, t in enumerate(texts))
    assert folding.find_in_source("xé̂y", "É") == (1, 3)
    assert folding.find_in_source("İİb", "b") == (2, 1) and folding.find_in_source("abc", "") is None
    pick = random.Random(2)
    for _ in range(500):
        text = "".join(pick.choice("aáÁéİßž ") for _ in range(12))
        low = pick.randrange(12)
        wanted = text[low : low + 3]
        found = folding.find_in_source(text, wanted)
        if folding.fold_text(wanted):
            assert folding.fold_text(text[found[0] : sum(found)]).startswith(folding.fold_text(wanted)) or folding.fold_text(wanted) in folding.fold_text(text[found[0] : sum(found)])
    assert [r.s for r in spark.createDataFrame([(" Projekt v  REALIZACI ",), (None,)], "t string").select(folding.fold_state("t").alias("s")).collect()] == ["projekt v realizaci", ""]


def test_folded_quotes_are_pieces_of_their_text(spark):
    rows = C.QUERIES["q127_folded_anchor"](spark, SF).collect()
    texts = {r.doc_id: r.text.translate(str.maketrans("aeiou", "áéíöů")) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    assert len(rows) == len(texts) == 200
    for r in rows:
        if len(texts[r.doc_id]) > 60:
            assert r.quote and r.quote in texts[r.doc_id]


def test_versions_outlive_a_killed_writer(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "k int, v string")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder)
    assert versions.commit(rows((1, "a"), (2, "b")), folder, 0) == 1
    first = versions.read(spark, folder)
    assert versions.upsert_rows(spark, folder, rows((2, "B"), (3, "new")), "k") == 2
    assert sorted(map(tuple, versions.read(spark, folder).collect())) == [(1, "a"), (2, "B")]
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "b")]
    with monkeypatch.context() as m:  # the data is written, the manifest never comes
        m.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            versions.upsert_rows(spark, folder, rows((1, "lost")), "k")
    assert versions.latest(spark, folder) == 2 and sorted(map(tuple, versions.read(spark, folder).collect())) == [(1, "a"), (2, "B")]
    with pytest.raises(versions.Conflict):
        versions.commit(rows((9, "late")), folder, 1)
    assert versions.commit(rows((5, "e")), folder, 2, append=True) == 3
    assert versions.read(spark, folder).count() == 3 and versions.read(spark, folder, 2).count() == 2
    gone = versions.vacuum(spark, folder, keep=1)
    assert len(gone) == 3 and versions.read(spark, folder).count() == 3


def test_a_writer_that_was_second_builds_on_the_first(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "k int, v string")
    versions.commit(rows((1, "a"), (2, "b")), folder, 0)
    tried = []

    def make(base):
        tried.append(1)
        if len(tried) == 1:
            versions.upsert_rows(spark, folder, rows((1, "A")), "k")
        return versions.upsert(base, rows((2, "B")), "k")

    assert versions.change(spark, folder, make) == 3 and len(tried) == 2
    assert sorted(map(tuple, versions.read(spark, folder).collect())) == [(1, "A"), (2, "B")]


def test_sheets_without_their_layout_are_refused(spark):
    sheet = lambda *rows: spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "row long, cells array<string>")
    labels = list(sheets.SUBSIDIES.values())
    with pytest.raises(sheets.LayoutChanged):
        sheets.subsidies(sheet(["x"], labels[1:]))
    with pytest.raises(sheets.LayoutChanged):
        sheets.subsidies(sheet(["x"], labels[:3]))
    with pytest.raises(sheets.LayoutChanged):
        sheets.subsidies(sheet(*[["x"]] * 20, labels))
    found = sheets.subsidies(sheet(["t"], labels, ["12", "45000.7", " p", None, "s", "1e3", "x"], [], ["000", "1", "", "", "", "", ""])).collect()
    assert [tuple(map(str, r)) for r in found] == [("00000012", "2023-03-15", "p", "", "s", "1000.0", "x")]


def test_registers_without_an_answer_are_null(spark):
    rows = [("1", "ekonomicke-subjekty", 1, "null"), ("1", "ekonomicke-subjekty-vr", 1, '{"zaznamy": []}'), ("1", "ekonomicke-subjekty-rzp", 1, '{"zaznamy": [{"primarniZaznam": true}]}'), ("2", "other", 1, "{}")]
    table = spark.createDataFrame(rows, "ico string, endpoint string, fetched_at int, body string")
    one, two = payloads.companies(table).orderBy("ico").collect()
    assert one.summary is None and one.statistics is None and one.public.directors is None and one.trades.trades == [] and one.trades.establishments == []
    assert (two.summary, two.statistics, two.public, two.trades) == (None,) * 4
    same = payloads.companies_of_tables(table.select("ico").distinct(), table).orderBy("ico").collect()
    assert same[0].trades.trades == [] and same[0].public.directors is None and same[1].public is None


def test_page_bodies_of_any_charset(spark):
    page = "<script>x<b></script><style>y</style><p>Žluť &amp; k&#367;&ncaron;&nbsp;&copy; &lt;b&gt;</p><!-- no --><noscript>z</noscript>"
    rows = [(1, ('<meta charset="windows-1250">' + page).encode("windows-1250")), (2, page.encode("utf-8")), (3, page.encode("windows-1250")), (4, b'<meta charset="no-such">' + page.encode()), (5, None), (6, b'<a href="x" data-cfemail="2a4b6a48044950">[m]</a> &#105;nfo&#64;b.cz'), (7, b'<META http-equiv=x content="text/html; charset=iso-8859-2">\xb9'), (8, b"")]
    got = {r.i: r.page_text for r in pages.page_texts(spark.createDataFrame(rows, "i int, body binary").withColumn("page_text", F.lit(1)), "body").collect()}
    assert got == {1: "Žluť & kůň ©", 2: "Žluť & kůň ©", 3: "Žluť & kůň ©", 4: "Žluť & kůň ©", 5: None, 6: "a@b.cz [m] info@b.cz", 7: "š", 8: ""}
    assert len(C.QUERIES["q131_page_texts"](spark, SF).where("page_text like '%a@b.cz%' or page_id % 3 = 2").collect()) == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_unchanged_vacancy_documents_are_used_again(spark):
    rows = spark.createDataFrame([("a", 2, "t2", "x2"), ("a", 1, "t1", None), ("b", 1, None, " ")], "ico string, pos int, title string, text string")
    stored = spark.createDataFrame([], "ico string, source string, id long, fetched_at int, sha256 string")
    found, todo = evidence.vacancy_documents(rows, stored)
    (one,) = todo.collect()
    assert one.text == "t1\n\n\n---\n\nt2\nx2" and found.count() == 1
    again = evidence.vacancy_documents(rows, todo.selectExpr("ico", "'mpsv_text' AS source", "7L AS id", "1 AS fetched_at", "sha256"))
    assert again[1].count() == 0 and [r.snapshot_id for r in again[0].collect()] == [7]


def test_coverage_of_a_stream(spark, tmp_path):
    """A gap is reported with each micro-batch: records older than what is retained."""
    schema = "source string, ts timestamp"
    spark.sql("SELECT 'a' AS source, timestamp'2024-01-05' AS ts UNION ALL SELECT 'a', timestamp'2023-11-01'").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = stream.with_late(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "2023-12-01")
    got = []
    q = rows.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    told = [p["observedMetrics"]["coverage"] for p in q.recentProgress if "coverage" in (p["observedMetrics"] or {})]
    assert sum(t["records"] for t in told) == 2 and sum(t["uncovered"] for t in told) == 1 and {r.uncovered for r in got} == {True, False}
