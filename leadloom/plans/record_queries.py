"""Queries of event recording, register answers, sheets, versions, page texts and vacancy documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.functions import folding
from leadloom.functions import text as X
from leadloom.operators import evidence, pages, recording
from leadloom.plans import fixtures as T
from leadloom.plans.catalogue import query
from leadloom.plans.fixtures import with_sql
from leadloom.sources import payloads, sheets, versions
from leadloom.sources.store import materialize, shared_dir
from leadloom.streaming import changes as stream

#: Letters between a record's date and its name, so that some names are out of reach and some quotes are cut.
_GAP = "event_id * 37 % 1500"


def happened(spark, d):
    """Register movements and vacancies as events; every thirteenth has a surname that the register doesn't know."""
    moves = T.movement(spark, d).select(
        "ico", "kind", "date", F.concat(F.lit("Jan Ý"), F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("name"))).alias("name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("isco"), F.col("event_id").alias("event")
    )
    jobs = T.vacancies(spark, d)[1].select("ico", F.lit("management_vacancy").alias("kind"), "date", F.lit(None).cast("string").alias("name"), "title", F.col("isco"), F.substring("title", 5, 20).cast("long").alias("event"))
    rows = moves.unionByName(jobs)
    blank = {c: F.lit(None).cast("string") for c in ("url", "role", "subject", "project")}
    return rows.withColumns(blank).withColumns({"months": F.lit(0), "days_left": F.lit(None).cast("int"), "amount": F.lit(None).cast("double"), "fresh": F.lit(False)})


def documents(spark, d):
    """A register document of each company with movements (but each eleventh), and one of its vacancies."""
    move = T.movement(spark, d)
    record = F.concat(F.lit('{"datumZapisu": "'), F.col("date").cast("string"), F.lit('", "adresa": "'), F.repeat(F.lit("š"), F.expr(f"cast({_GAP} as int)")), F.lit('", "jmeno": "Jan", "prijmeni": "Ý'), F.col("name"), F.lit('"}'))
    number = F.col("ico").cast("long")
    lists = move.groupBy("ico").agg(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))).alias("rows"))
    register = lists.where(number % 11 != 0).select((number * 2).alias("id"), "ico", F.lit("ares").alias("source"), F.array_join(F.transform("rows", lambda r: r["r"]), ", ").alias("text"))
    jobs = T.vacancies(spark, d)[1].groupBy("ico").agg(F.array_sort(F.collect_list("title")).alias("rows"))
    texts = jobs.select((number * 2 + 1).alias("id"), "ico", F.lit("mpsv").alias("source"), F.array_join(F.transform(F.filter("rows", lambda t, i: i % 3 != 2), lambda t: F.upper(t)), "; ").alias("text"))
    return register.unionByName(texts.withColumn("text", F.when(number % 2 == 0, F.lower("text")).otherwise(F.col("text")))).withColumn("url", F.lit(None).cast("string"))


_MOVES = "SELECT ico, kind, CAST(date AS VARCHAR) AS day, 'Ý' || CASE WHEN event_id % 13 = 0 THEN 'x' ELSE name END AS last, event_id AS event FROM movement"
_REGISTER = f"""SELECT CAST(ico AS BIGINT) * 2 AS id, ico, string_agg('{{"datumZapisu": "' || CAST(date AS VARCHAR) || '", "adresa": "' || repeat('š', CAST({_GAP} AS INTEGER)) || '", "jmeno": "Jan", "prijmeni": "Ý' || name || '"}}', ', ' ORDER BY event_id) AS text
    FROM movement WHERE CAST(ico AS BIGINT) % 11 <> 0 GROUP BY ico"""
_JOBS = "SELECT ico, title, o_orderkey AS event FROM vacancy"
_JOB_TEXTS = """SELECT CAST(ico AS BIGINT) * 2 + 1 AS id, ico, CASE WHEN CAST(ico AS BIGINT) % 2 = 0 THEN lower(t) ELSE t END AS text FROM (
    SELECT ico, coalesce(string_agg(upper(title), '; ' ORDER BY title) FILTER (n % 3 <> 2), '') AS t FROM (SELECT ico, title, row_number() OVER (PARTITION BY ico ORDER BY title) - 1 AS n FROM vacancy) GROUP BY ico)"""
#: The reader's rule over positions: the first place of the date with the name behind it, else the first place of the name.
_QUOTED = """SELECT *, list_filter(starts, lambda p: strpos(substr(text, p, 1200), last) > 0)[1] AS place, strpos(text, '"prijmeni": "' || last || '"') AS named, strpos(text, last) AS bare FROM (
    SELECT *, list_transform(range(1, len(cut)), lambda i: CAST(1 + list_sum(list_transform(cut[1:i], lambda x: length(x))) + (i - 1) * 12 AS BIGINT)) AS starts FROM (
    SELECT m.*, r.id AS snapshot_id, r.text, string_split(r.text, '"' || m.day || '"') AS cut FROM moves m LEFT JOIN register r ON m.ico = r.ico))"""
_CUT = """SELECT ico, kind, event, snapshot_id, CASE
    WHEN place IS NOT NULL THEN substr(text, place - 15, 15 + strpos(substr(text, place), last) - 1 + length(last) + 90)
    WHEN named > 0 THEN substr(text, greatest(named - 320, 1), named - greatest(named - 320, 1) + length(last) + 14 + 90)
    WHEN bare > 0 THEN substr(text, greatest(bare - 320, 1), bare - greatest(bare - 320, 1) + length(last) + 90) END AS quote FROM quoted
    UNION ALL SELECT j.ico, 'management_vacancy', j.event, t.id, CASE WHEN strpos(t.text, j.title) > 0 THEN substr(t.text, greatest(strpos(t.text, j.title) - 320, 1), strpos(t.text, j.title) - greatest(strpos(t.text, j.title) - 320, 1) + length(j.title) + 90) END
    FROM jobs j LEFT JOIN texts t ON j.ico = t.ico"""
ANCHORS = {"moves": _MOVES, "register": _REGISTER, "jobs": _JOBS, "texts": _JOB_TEXTS, "quoted": _QUOTED, "cut": _CUT}


@query("q124_evidence_anchor", with_sql("SELECT ico, kind, event, snapshot_id, quote FROM cut", "movement", "vacancy", **ANCHORS))
def evidence_anchor(spark, d):
    rows = happened(spark, d)
    texts = documents(spark, d)
    source = F.when(F.col("kind") == "management_vacancy", "mpsv").otherwise("ares")
    read = rows.withColumn("source", source).join(texts.select("ico", "source", F.col("id").alias("snapshot_id"), "text"), ["ico", "source"], "left")
    return read.select("ico", "kind", "event", "snapshot_id", recording.evidence_quote(F.col("text")).alias("quote"))


@query("q125_record_events", with_sql(
    "SELECT * FROM (SELECT 'written' AS what, count(*) FILTER (snapshot_id IS NOT NULL) AS n FROM cut UNION ALL SELECT 'orphaned', count(*) FILTER (snapshot_id IS NULL) FROM cut UNION ALL SELECT 'fact', count(*) FILTER (quote IS NOT NULL) FROM cut "
    "UNION ALL SELECT 'inference', count(*) FILTER (quote IS NULL AND snapshot_id IS NOT NULL) FROM cut UNION ALL SELECT 'discard', 0 UNION ALL SELECT 'again', 0)", "movement", "vacancy", **ANCHORS))  # fmt: skip
def record_events(spark, d):
    """Tallies of a recording, and how many claims a second run of it adds."""
    folder = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    rows, texts = materialize(happened(spark, d), "happened"), materialize(documents(spark, d), "texts")
    first = recording.record(rows, texts, folder, 1)
    again = recording.record(rows, texts, folder, 2)
    tallies = [(k, v) for k, v in first.items() if k != "added"] + [("again", again["added"])]
    return spark.createDataFrame(tallies, "what string, n long")


@query("q126_recorded_claims", with_sql("SELECT DISTINCT ico, 'now:' || kind AS kind, quote, CASE WHEN quote IS NULL THEN 'inference' ELSE 'fact' END AS state, snapshot_id FROM cut WHERE snapshot_id IS NOT NULL", "movement", "vacancy", **ANCHORS))
def recorded_claims(spark, d):
    folder = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    recording.record(happened(spark, d), documents(spark, d), folder, 1)
    return versions.read(spark, folder).select("ico", "kind", "quote", "state", "snapshot_id").distinct()


@query("q127_folded_anchor")
def folded_anchor(spark, d):
    """Titles in small letters without marks found in texts with both, cut from the texts themselves."""
    found = T.table(spark, d, "documents").select("doc_id", F.translate("text", "aeiou", "áéíöů").alias("text"), F.lower(F.substring("text", 40, 25)).alias("wanted"))
    return found.select("doc_id", recording.around_folded(F.col("text"), F.col("wanted")).alias("quote"), folding.fold_exact(F.substring("text", 1, 60)).alias("folded"))


@query("q128_versioned_upsert", with_sql("SELECT c.ico, coalesce(l.kind, 'as before') AS state, 2 AS version FROM company c LEFT JOIN latest l ON c.ico = l.ico", "company", "change", latest="SELECT ico, arg_max(kind, (batch, pos)) AS kind FROM change GROUP BY ico"))
def versioned_upsert(spark, d):
    """The base written as a version, refreshed rows as the next one; a reader of the first still sees it."""
    folder = f"{shared_dir(spark)}/base-{uuid.uuid4().hex}"
    base = T.company(spark, d).select("ico", F.lit("as before").alias("state"))
    first = versions.commit(base, folder, 0)
    before = versions.read(spark, folder, first)
    versions.upsert_rows(spark, folder, stream.last_in_batch(T.change(spark, d)).select("ico", F.col("kind").alias("state")), "ico")
    held = before.select("ico", F.col("state").alias("was"))
    now = versions.read(spark, folder).join(held, "ico").where("was = 'as before'")
    return now.select("ico", "state", F.lit(versions.latest(spark, folder)).cast("int").alias("version"))


def landed_sheets(spark, d):
    """Subsidies as three sheets: titles above the header, other orders of columns, a column too many, a label twice."""
    rows = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    serial = F.datediff(F.date_add(F.col("l_shipdate").cast("date"), T.SUBSIDY_SHIFT), F.lit("1899-12-30").cast("date"))
    values = {
        "ico": F.when(F.col("l_orderkey") % 23 == 0, "0").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))), "signed": F.when(F.col("l_linenumber") == 7, "neuvedeno").otherwise(F.concat(serial.cast("string"), F.lit(".0"))),
        "project": F.concat(F.lit(" "), F.col("p_name")), "description": F.col("p_type"), "state": F.col("l_returnflag"), "total_czk": F.col("l_extendedprice").cast("string"), "programme": F.col("p_type"),
    }
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 30).alias("row")
    made = []
    for k, order in enumerate((list(values), list(values)[::-1], [*list(values)[3:], *list(values)[:3]])):
        own = rows.where(F.col("l_orderkey") % 3 == k)
        labels = [sheets.SUBSIDIES[n] for n in order]
        extra = ([F.lit("x").cast("string")], ["Poznámka"]) if k == 1 else ([], [])
        cells = F.array(*extra[0], *[values[n].cast("string") for n in order])
        top = spark.createDataFrame([(0, ["Seznam operací"]), (1, [None, "stav ke dni"]), (k + 3, [*extra[1], *labels])], "row long, cells array<string>")
        made.append(own.select(place, cells.alias("cells")).unionByName(top))
    return made


@query("q129_sheet_rows", with_sql("SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) + 8088 END AS signed, p_name AS project, p_type AS description, l_returnflag AS state, CAST(l_extendedprice AS DOUBLE) AS total_czk, p_type AS programme FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 23 <> 0 AND o_custkey <> 0", "company"))
def sheet_rows(spark, d):
    first, *rest = map(sheets.subsidies, landed_sheets(spark, d))
    for one in rest:
        first = first.unionByName(one)
    return first


def answers(spark, d):
    """Register answers made of the tables: identity of customers, people of movements, sites of suppliers."""
    k = F.col("c_custkey")
    ico = F.lpad(k.cast("string"), 8, "0").alias("ico")
    customers = T.table(spark, d, "customer")
    seat = F.struct(F.col("c_mktsegment").alias("nazevUlice"), k.alias("kodAdresnihoMista"), F.concat(F.lit("M"), (k % 9).cast("string")).alias("nazevObce"))
    state = F.struct(F.when(k % 4 == 0, "AKTIVNI").when(k % 4 == 1, "NEEXISTUJICI").when(k % 4 == 2, "").alias("stavZdrojeIr"))
    files = F.array(F.struct(F.lit("res").alias("datovyZdroj"), F.lit("no").alias("spisovaZnacka")), F.struct(F.when(k % 3 != 0, "vr").alias("datovyZdroj"), F.concat(F.lit("C "), k.cast("string")).alias("spisovaZnacka")))
    summary = customers.select(ico, F.lit("ekonomicke-subjekty").alias("endpoint"), F.to_json(F.struct(F.col("c_name").alias("obchodniJmeno"), F.lit("112").alias("pravniForma"), seat.alias("sidlo"), state.alias("seznamRegistraci"), files.alias("dalsiUdaje"))).alias("body"))
    old = F.struct(F.lit(False).alias("primarniZaznam"), F.struct(F.lit("000").alias("kategoriePoctuPracovniku")).alias("statistickeUdaje"), F.lit("00").alias("czNacePrevazujici"))
    now = F.struct((k % 5 != 0).alias("primarniZaznam"), F.struct(F.lit("240").alias("kategoriePoctuPracovniku")).alias("statistickeUdaje"), F.col("c_mktsegment").alias("czNacePrevazujici"))
    statistics = customers.where(k % 7 != 0).select(ico, F.lit("ekonomicke-subjekty-res").alias("endpoint"), F.to_json(F.struct(F.array(old, now).alias("zaznamy"))).alias("body"))
    gone = F.when(F.endswith("kind", F.lit("departed")), F.col("date").cast("string"))
    person = F.struct(F.when(F.col("event_id") % 4 == 0, "Ing.").alias("titulPredJmenem"), F.when(F.col("event_id") % 5 != 0, "Jan").otherwise("").alias("jmeno"), F.col("name").alias("prijmeni"))
    member = F.struct(F.col("date").cast("string").alias("datumZapisu"), gone.alias("datumVymazu"), person.alias("fyzickaOsoba"))
    firm = F.struct(F.concat(F.lit("Firma "), F.col("name")).alias("obchodniJmeno"))
    holder = F.struct(F.col("date").cast("string").alias("datumZapisu"), gone.alias("datumVymazu"), F.struct(F.when(~F.col("legal_entity"), person).alias("fyzickaOsoba"), F.when(F.col("legal_entity"), firm).alias("pravnickaOsoba")).alias("osoba"))
    moves = T.movement(spark, d)
    lists = moves.groupBy("ico").agg(
        F.collect_list(F.when(F.startswith("kind", F.lit("director")), member)).alias("d"), F.collect_list(F.when(F.startswith("kind", F.lit("owner")), holder)).alias("o"),
    )
    people = lists.select("ico", F.lit("ekonomicke-subjekty-vr").alias("endpoint"), F.to_json(F.struct(F.array(F.struct(F.lit(True).alias("primarniZaznam"), F.array(F.struct(F.col("d").alias("clenoveOrganu"))).alias("statutarniOrgany"), F.array(F.struct(F.col("o").alias("spolecnik"))).alias("spolecnici"))).alias("zaznamy"))).alias("body"))
    site = F.struct(F.floor(F.col("s_suppkey") / 4).cast("string").alias("icp"), F.col("s_name").alias("nazev"))
    trade = F.struct(F.concat(F.lit("T"), (F.col("s_suppkey") % 5).cast("string")).alias("predmetPodnikani"), F.when(F.col("s_suppkey") % 3 == 0, "2020-01-01").alias("datumZaniku"), F.array(F.struct(F.col("s_name").alias("prijmeni"), F.when(F.col("s_suppkey") % 2 == 0, "2021-01-01").alias("platnostDo"))).alias("odpovedniZastupci"), F.array(site).alias("provozovny"))
    of = F.lpad((F.col("s_suppkey") % 20 + 1).cast("string"), 8, "0").alias("ico")
    trades = T.table(spark, d, "supplier").groupBy(of).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", trade.alias("t")))).alias("rows"))
    trades = trades.select("ico", F.lit("ekonomicke-subjekty-rzp").alias("endpoint"), F.to_json(F.struct(F.array(F.struct(F.transform("rows", lambda r: r["t"]).alias("zivnosti"), F.struct(F.size("rows").alias("pocetCelkem")).alias("provozovnyStav"))).alias("zaznamy"))).alias("body"))
    stale = summary.select("ico", "endpoint", F.lit('{"obchodniJmeno": "old"}').alias("body"), F.lit(1).alias("fetched_at"))
    fresh = summary.unionByName(statistics).unionByName(people).unionByName(trades).withColumn("fetched_at", F.lit(2))
    return fresh.unionByName(stale)


_PERSON_SQL = "trim(CASE WHEN event_id % 4 = 0 THEN 'Ing. ' ELSE '' END || CASE WHEN event_id % 5 <> 0 THEN 'Jan ' ELSE '' END || name)"
REGISTERS = {
    "people": f"""SELECT ico, count(*) FILTER (kind = 'director_joined') AS directors, count(*) FILTER (kind = 'director_departed') AS departed_directors, count(*) FILTER (kind = 'owner_joined') AS owners,
        count(*) FILTER (kind = 'owner_departed') AS departed_owners, coalesce(string_agg(CASE WHEN legal_entity THEN 'Firma ' || name ELSE {_PERSON_SQL} END, ',' ORDER BY CASE WHEN legal_entity THEN 'Firma ' || name ELSE {_PERSON_SQL} END) FILTER (kind = 'owner_joined'), '') AS owner_names FROM movement GROUP BY ico""",
    "trade": """SELECT lpad(CAST(s_suppkey % 20 + 1 AS VARCHAR), 8, '0') AS ico, coalesce(string_agg('T' || CAST(s_suppkey % 5 AS VARCHAR), ',' ORDER BY s_suppkey) FILTER (s_suppkey % 3 <> 0), '') AS trades,
        coalesce(string_agg(s_name, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 <> 0), '') AS representatives, count(*) AS total FROM supplier GROUP BY 1""",
    "sites": "SELECT ico, string_agg(CAST(icp AS VARCHAR) || ':' || name, ',' ORDER BY first) AS sites FROM (SELECT lpad(CAST(s_suppkey % 20 + 1 AS VARCHAR), 8, '0') AS ico, s_suppkey // 4 AS icp, min(s_suppkey) AS first, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1, 2) GROUP BY ico",
    "keys": "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ico FROM customer UNION SELECT ico FROM people UNION SELECT ico FROM trade",
}


@query("q130_register_answers", with_sql(
    "SELECT k.ico, c.c_name AS name, CASE c.c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS insolvent, CASE WHEN c.c_custkey % 3 <> 0 THEN 'C ' || CAST(c.c_custkey AS VARCHAR) END AS file_number, "
    "CASE WHEN c.c_custkey % 7 <> 0 THEN CASE WHEN c.c_custkey % 5 = 0 THEN '00' ELSE c.c_mktsegment END END AS nace, p.directors, p.departed_directors, p.owners, p.departed_owners, p.owner_names, t.trades, t.representatives, s.sites, t.total AS establishments_total "
    "FROM keys k LEFT JOIN customer c ON lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') = k.ico LEFT JOIN people p ON p.ico = k.ico LEFT JOIN trade t ON t.ico = k.ico LEFT JOIN sites s ON s.ico = k.ico", "movement", **REGISTERS))  # fmt: skip
def register_answers(spark, d):
    rows = payloads.companies(answers(spark, d))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return rows.select(
        "ico", "summary.name", "summary.insolvent", "summary.file_number", "statistics.nace", *[count(f"public.{c}").alias(c) for c in ("directors", "departed_directors", "owners", "departed_owners")],
        F.array_join(F.array_sort(F.transform("public.owners", lambda o: o["name"])), ",").alias("owner_names"), F.array_join("trades.trades", ",").alias("trades"), names("trades.responsible_representatives", "name").alias("representatives"),
        F.array_join(F.transform("trades.establishments", lambda s: F.concat_ws(":", s["icp"], s["name"])), ",").alias("sites"), F.col("trades.establishments_total").cast("long").alias("establishments_total"),
    )


@query("q131_page_texts")
def page_texts(spark, d):
    """Stored page bodies, a third of them in another encoding that they declare, with a hidden address."""
    rows = T.table(spark, d, "pages")
    blob = '<a data-cfemail="2a4b6a48044950"></a>'
    text = F.concat(F.when(F.col("page_id") % 3 == 1, '<meta charset="windows-1250">').otherwise(""), F.lit(blob), F.col("html"))
    body = F.when(F.col("page_id") % 3 == 2, F.encode(F.lit("<p>&#352;koda &scaron; &copy;</p>"), "UTF-16")).otherwise(text.cast("binary"))
    return pages.page_texts(rows.select("page_id", body.alias("body")), "body").select("page_id", "page_text")


_BLOB = "SELECT ico, string_agg(title || chr(10) || 'job of ' || occupation, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM vacancy GROUP BY ico"


@query("q132_vacancy_documents", with_sql("SELECT ico, text, CASE WHEN CAST(ico AS BIGINT) % 3 = 0 THEN CAST(ico AS BIGINT) + 1000000 END AS snapshot_id FROM blobs", "vacancy", blobs=_BLOB))
def vacancy_documents(spark, d):
    """Documents of vacancies; those of every third company are stored already, others' stored ones are of older texts."""
    rows = T.vacancies(spark, d)[1].select("ico", F.substring("title", 5, 20).cast("long").alias("pos"), "title", F.concat(F.lit("job of "), X.occupation_group("isco")).alias("text"))
    none = spark.createDataFrame([], "ico string, source string, id long, fetched_at int, sha256 string")
    made = evidence.vacancy_documents(rows, none)[0]
    number = F.col("ico").cast("long")
    kept = made.select("ico", F.lit("mpsv_text").alias("source"), (number + 1_000_000).alias("id"), F.lit(2).alias("fetched_at"), F.when(number % 3 == 0, F.col("sha256")).otherwise("older").alias("sha256"))
    first = made.select("ico", F.lit("mpsv_text").alias("source"), number.alias("id"), F.lit(1).alias("fetched_at"), "sha256")
    return evidence.vacancy_documents(rows, kept.unionByName(first))[0].select("ico", "text", "snapshot_id")


FEEDS = (("movement", "2023-12-01", 2, 7, 30), ("vacancy", "2023-12-20", 10, 7, 60), ("tender", "2023-01-01", 20, 14, 30), ("subsidy", "2023-01-01", 35, 30, 120), ("nothing", "2023-01-01", 1, 1, 30))
_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS source, CAST(max({c}) AS DATE) AS reaches_to, count(*) AS records FROM {s}" for s, c in (("movement", "date"), ("vacancy", "date"), ("tender", "deadline"), ("subsidy", "signed")))
_FEEDS = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', DATE '{r}', {a}, {b}, {w})" for s, r, a, b, w in FEEDS) + ") t(source, retained_from, lag, cadence, width)"


@query("q133_coverage", with_sql(
    f"SELECT f.source, coalesce(r.records, 0) AS records, r.reaches_to, f.retained_from, DATE '{T.AS_OF}' - CAST(f.width AS INTEGER) AS wanted_from, "
    f"CASE WHEN f.retained_from > DATE '{T.AS_OF}' - CAST(f.width AS INTEGER) OR lag + cadence > width OR r.records IS NULL THEN 'cannot' ELSE 'complete' END AS answer, "
    f"CASE WHEN f.retained_from > DATE '{T.AS_OF}' - CAST(f.width AS INTEGER) THEN 'not_retained' WHEN lag + cadence > width THEN 'too_slow' WHEN r.records IS NULL THEN 'nothing_came' END AS why FROM feeds f LEFT JOIN found r ON f.source = r.source",
    "movement", "vacancy", "tender", "subsidy", found=_ROWS, feeds=_FEEDS))
def coverage(spark, d):
    feeds = spark.createDataFrame(FEEDS, "source string, retained_from string, lag int, cadence int, width int")
    rows = [T.movement(spark, d).select(F.lit("movement").alias("source"), F.col("date").alias("ts")), T.vacancies(spark, d)[1].select(F.lit("vacancy").alias("source"), F.col("date").alias("ts"))]
    rows += [T.tender(spark, d).select(F.lit("tender").alias("source"), F.col("deadline").alias("ts")), T.subsidy(spark, d).select(F.lit("subsidy").alias("source"), F.col("signed").alias("ts"))]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return stream.coverage(union, feeds, T.AS_OF)
