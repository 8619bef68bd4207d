"""Queries over whole tables, one for each group of operators, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators import audit, evidence, events, facets, pages, qualify, select, study
from leadloom.plans import fixtures as T
from leadloom.plans.fixtures import AS_OF, with_sql
from leadloom.sources import tables
from leadloom.sources.store import materialize
from leadloom.streaming import changes as stream

BRIEF = qualify.Brief(nace=("1", "2", "3", "45", "77123"), bands=("120", "210", "220", "230", "310"), forms=("112", "121"), regions=("AFRICA", "AMERICA", "ASIA", "EUROPE"), origin=(50.0, 15.0), km=150.0)
WIDTHS = (7, 14, 30, 60, 90)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _prefix(column: str = "nace") -> str:
    return "(" + " OR ".join(f"{column} LIKE '{p}%' OR '{p}' LIKE {column} || '%'" for p in BRIEF.nace) + ")"


def _km(lat: str, lon: str) -> str:
    a, b = (repr(v) for v in BRIEF.origin)
    h = f"pow(sin((radians({lat}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({lat})) * pow(sin(radians({lon} - {b}) / 2), 2)"
    return f"floor(2 * 6371 * asin(sqrt({h})) * 10 + 0.5) / 10"


AGE = "date_diff('day', {}, DATE '" + AS_OF + "')"
PLACED = f"""SELECT c.*, p.km, p.place, p.site_km FROM company c LEFT JOIN (
    SELECT ico, arg_min(km, km * 1000000000000 + pos) AS km, arg_min(place, km * 1000000000000 + pos) AS place, min(CASE WHEN place = 'site' THEN km END) AS site_km FROM (
      SELECT ico, 0 AS pos, 'seat' AS place, {_km('lat', 'lon')} AS km FROM company UNION ALL SELECT ico, pos + 1, 'site', {_km('lat', 'lon')} FROM site) WHERE km IS NOT NULL GROUP BY ico) p ON c.ico = p.ico"""
REASON = f"""CASE WHEN nace = '' THEN 'nace_unknown' WHEN NOT {_prefix()} THEN 'nace' WHEN band = '' THEN 'size_unknown' WHEN band NOT IN {_in(BRIEF.bands)} THEN 'size'
    WHEN form NOT IN {_in(BRIEF.forms)} THEN 'legal_form' WHEN region NOT IN {_in(BRIEF.regions)} THEN 'region' WHEN km IS NULL THEN 'location_unknown' WHEN km > 155 THEN 'outside_radius' END"""
JUDGED = f"SELECT *, {REASON} AS reject_reason FROM placed"
COUNTS = "SELECT ico, count(*) AS sites_total, count(*) FILTER (active) AS sites_active FROM site GROUP BY ico"
VERDICT = """SELECT c.ico, CASE WHEN insolvent OR name LIKE '% v likvidaci' THEN 'exclude' WHEN coalesce(sites_total, 0) > 0 AND sites_active = 0 THEN 'deprioritise' ELSE 'ok' END AS verdict,
    coalesce(sites_total > 0 AND sites_active = 0, false) AS demoted, CAST(insolvent AS INTEGER) + CAST(name LIKE '% v likvidaci' AS INTEGER) + CAST(coalesce(sites_total > 0 AND sites_active = 0, false) AS INTEGER) AS n_findings
    FROM company c LEFT JOIN site_counts s ON c.ico = s.ico"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return qualify.apply_brief(T.company(spark, d), T.site(spark, d), BRIEF)


@query("q01_register_select", with_sql(f"SELECT ico, nace, band, form FROM company WHERE ended IS NULL AND band IN {_in(BRIEF.bands)} AND form IN {_in(BRIEF.forms)} AND (nace = '' OR {_prefix()})", "company"))
def register_select(spark, d):
    return qualify.select_register(T.company(spark, d), BRIEF).select("ico", "nace", "band", "form")


@query("q02_brief_reasons", with_sql("SELECT ico, reject_reason, km, place FROM judged", "company", "site", placed=PLACED, judged=JUDGED))
def brief_reasons(spark, d):
    return judged(spark, d).select("ico", "reject_reason", "km", "place")


@query("q03_brief_funnel", with_sql("SELECT coalesce(reject_reason, 'pass') AS reason, count(*) AS n FROM judged GROUP BY 1", "company", "site", placed=PLACED, judged=JUDGED))
def brief_funnel(spark, d):
    return qualify.funnel(judged(spark, d))


@query("q04_negative_verdict", with_sql("SELECT ico, verdict, demoted, n_findings FROM verdicts", "company", "site", site_counts=COUNTS, verdicts=VERDICT))
def negative_verdict(spark, d):
    rows = qualify.with_verdict(T.company(spark, d), T.site(spark, d))
    return rows.select("ico", "verdict", "demoted", F.size("findings").alias("n_findings"))


@query("q05_facets_grouping_sets", with_sql("""SELECT CASE WHEN GROUPING(nace) = 0 THEN 'nace' WHEN GROUPING(band) = 0 THEN 'band' ELSE 'district' END AS facet,
    CASE WHEN GROUPING(nace) = 0 THEN nace WHEN GROUPING(band) = 0 THEN band ELSE district END AS value, count(*) AS n FROM company GROUP BY GROUPING SETS ((nace), (band), (district))""", "company"))
def facet_counts(spark, d):
    return facets.facet_counts(T.company(spark, d))


@query("q06_code_rollup", with_sql("SELECT substr(nace, 1, 2) AS division, nace AS code, count(*) AS n, coalesce(nace = substr(nace, 1, 2), false) AS bare FROM company WHERE nace <> '' GROUP BY GROUPING SETS ((substr(nace, 1, 2), nace), (substr(nace, 1, 2)))", "company"))
def code_rollup(spark, d):
    return facets.code_rollup(T.company(spark, d))


@query("q07_region_rollup", with_sql("SELECT substr(district, 1, 5) AS region_code, count(*) AS n FROM company GROUP BY 1", "company"))
def region_rollup(spark, d):
    return facets.region_counts(T.company(spark, d))


def _bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*enumerate(("000", *T.BANDS))], "pos int, band string")


@query("q08_band_zero_fill", with_sql("SELECT CAST(b.pos AS INTEGER) AS pos, b.band, coalesce(n, 0) AS n FROM bands b LEFT JOIN (SELECT band, count(*) AS n FROM company GROUP BY band) c ON b.band = c.band", "company",
    bands="SELECT unnest(range(11)) AS pos, unnest(['000', " + ", ".join(f"'{b}'" for b in T.BANDS) + "]) AS band"))
def band_zero_fill(spark, d):
    return facets.band_counts(T.company(spark, d), _bands(spark))


@query("q09_lookup_semi", with_sql(f"SELECT ico, band FROM company WHERE ico IN (SELECT ico FROM change) AND ended IS NULL AND form IN {_in(BRIEF.forms)} AND (nace = '' OR {_prefix()}) AND (band = '' OR band IN {_in(BRIEF.bands)})", "company", "change"))
def lookup_semi(spark, d):
    return qualify.lookup(T.company(spark, d), T.change(spark, d), BRIEF).select("ico", "band")


LATEST = "SELECT ico, arg_max(kind, batch * 1000000000000 + pos) AS kind FROM change GROUP BY ico"
PLAN = "SELECT l.ico, l.kind, CASE WHEN c.ico IS NULL THEN 'new' WHEN l.kind = 'DEL' THEN 'gone' ELSE 'refresh' END AS plan FROM latest l LEFT JOIN company c ON l.ico = c.ico"


@query("q10_change_split", with_sql("SELECT * FROM plan", "company", "change", latest=LATEST, plan=PLAN))
def change_split(spark, d):
    return facets.change_plan(T.change(spark, d), T.company(spark, d))


@query("q11_latest_change", with_sql("SELECT * FROM latest", "change", latest=LATEST))
def latest_change(spark, d):
    return facets.latest_changes(T.change(spark, d))


LISTS = "SELECT ico, kind, count(*) AS people, count(DISTINCT date) AS dates, min(date) AS only_day FROM movement GROUP BY ico, kind"
KEPT = """SELECT m.* FROM movement m JOIN lists l ON m.ico = l.ico AND m.kind = l.kind LEFT JOIN company c ON m.ico = c.ico
    WHERE NOT (people > 1 AND dates = 1) AND NOT (dates = 1 AND coalesce(date_diff('day', founded, only_day) < 400, false))"""


def _window(day: str, days: int) -> str:
    return f"{AGE.format(day)} BETWEEN 0 AND {days}"


REGISTRY = f"SELECT * FROM kept WHERE {_window('date', 30)}"
PAIRS = """SELECT a.ico, a.name, unnest([a.date, b.date]) AS date FROM registry a JOIN registry b ON a.ico = b.ico AND a.name = b.name WHERE a.kind LIKE '%\\_joined' ESCAPE '\\' AND b.kind LIKE '%\\_departed' ESCAPE '\\' AND abs(date_diff('day', a.date, b.date)) <= 3"""
CLEAN = """SELECT * FROM registry e WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ico = e.ico AND p.name = e.name AND p.date = e.date)
    AND NOT (e.kind LIKE '%departed' AND EXISTS (SELECT 1 FROM listed s WHERE s.ico = e.ico AND s.role = split_part(e.kind, '_', 1) AND lower(s.name) = lower(e.name)))"""
REG = {"lists": LISTS, "kept": KEPT, "registry": REGISTRY, "pairs": PAIRS, "clean": CLEAN}


def registry(spark, d):
    return events.registry_events(T.movement(spark, d), T.company(spark, d), AS_OF, 30)


def clean(spark, d):
    return events.drop_reentries(registry(spark, d), T.listed(spark, d))


@query("q12_registry_events", with_sql("SELECT event_id, ico, kind, name, date FROM registry", "company", "movement", lists=LISTS, kept=KEPT, registry=REGISTRY))
def registry_events(spark, d):
    return registry(spark, d).select("event_id", "ico", "kind", "name", "date")


@query("q13_mass_guard", with_sql("SELECT event_id FROM kept", "company", "movement", lists=LISTS, kept=KEPT))
def mass_guard(spark, d):
    return events.mass_guarded(T.movement(spark, d), T.company(spark, d)).select("event_id")


@query("q14_drop_reentries", with_sql("SELECT event_id, ico, kind, name, date FROM clean", "company", "movement", "listed", **REG))
def drop_reentries(spark, d):
    return clean(spark, d).select("event_id", "ico", "kind", "name", "date")


FLOOR = "2019-01-01"
RECORD = f"""SELECT ico, date, occupation, CASE WHEN min(CASE WHEN o_orderkey % 2 = 0 THEN title END) IS NOT NULL THEN min(CASE WHEN o_orderkey % 2 = 0 THEN title END) ELSE min(title) END AS title,
    CASE WHEN min(CASE WHEN o_orderkey % 2 = 0 THEN title END) IS NOT NULL THEN 0 ELSE 1 END AS origin FROM vacancy WHERE date >= DATE '{FLOOR}' GROUP BY ico, date, occupation"""
DEPTH = "SELECT ico, count(DISTINCT date_trunc('month', date)) AS months, CASE WHEN count(DISTINCT date_trunc('month', date)) >= 12 THEN 'high' WHEN count(DISTINCT date_trunc('month', date)) >= 6 THEN 'low' END AS confidence FROM record GROUP BY ico"
GROWTH = f"SELECT r.ico, r.date, r.occupation, d.months, d.confidence FROM record r JOIN depth d ON r.ico = d.ico WHERE confidence IS NOT NULL AND occupation IN {_in(T.GROUPS)} AND {_window('date', 24)}"
VAC = {"record": RECORD, "depth": DEPTH, "growth": GROWTH}


def record(spark, d):
    return events.vacancy_record(*T.vacancies(spark, d), FLOOR)


def growth(spark, d):
    return events.vacancy_events(record(spark, d), T.GROUPS, AS_OF, 24)


@query("q15_vacancy_union", with_sql("SELECT ico, date, occupation, title, CAST(origin AS INTEGER) AS origin FROM record", "vacancy", record=RECORD))
def vacancy_union(spark, d):
    return record(spark, d)


@query("q16_depth_confidence", with_sql("SELECT * FROM depth", "vacancy", record=RECORD, depth=DEPTH))
def depth_confidence(spark, d):
    return events.observation_depth(record(spark, d))


@query("q17_vacancy_events", with_sql("SELECT * FROM growth", "vacancy", **VAC))
def vacancy_events(spark, d):
    return growth(spark, d).select("ico", "date", "occupation", "months", "confidence")


def _project(title: str = "project", both: str = "project || ' ' || description") -> str:
    first, *rest = T.RULES
    word = lambda p: p.replace(r"\b", "")
    has = lambda text, w: f"regexp_matches(lower({text}), '\\b{w}\\b')"
    return f"CASE WHEN {has(both, word(first[1]))} THEN '{first[0]}' " + " ".join(f"WHEN {has(title, word(p))} THEN '{n}'" for n, p in rest) + " ELSE 'other' END"


FUNDING = f"""SELECT *, {AGE.format('signed')} AS age_days, {AGE.format('signed')} <= (SELECT {AGE.format('max(signed)')} FROM subsidy) + 30 AS fresh FROM (SELECT *, {_project()} AS project_kind FROM subsidy)
    WHERE state IN {_in(T.LIVE)} AND {_window('signed', 120)} AND project_kind IN {_in(T.SIGNAL)}"""


def funding(spark, d):
    return events.funding_events(T.subsidy(spark, d), T.RULES, T.SIGNAL, T.LIVE, AS_OF)


@query("q18_subsidy_classified", with_sql(f"SELECT {_project()} AS project_kind, count(*) AS n, sum(CAST(total AS DECIMAL(18, 2))) AS total FROM subsidy GROUP BY 1", "subsidy"))
def subsidy_classified(spark, d):
    return T.subsidy(spark, d).groupBy(events.project_kind(T.RULES).alias("project_kind")).agg(F.count("*").alias("n"), F.sum(F.col("total").cast("decimal(18,2)")).alias("total"))


@query("q19_funding_events", with_sql("SELECT ico, signed, project, project_kind, CAST(age_days AS INTEGER) AS age_days, fresh FROM funding", "subsidy", funding=FUNDING))
def funding_events(spark, d):
    return funding(spark, d).select("ico", "signed", "project", "project_kind", "age_days", "fresh")


OPEN = f"SELECT ico, number, date_diff('day', DATE '{AS_OF}', deadline) AS days_left FROM tender WHERE relevant AND status = 'open' AND deadline >= DATE '{AS_OF}'"


@query("q20_tender_open", with_sql("SELECT ico, number, CAST(days_left AS INTEGER) AS days_left FROM open_tender", "tender", open_tender=OPEN))
def tender_open(spark, d):
    return events.tender_events(T.tender(spark, d), AS_OF).select("ico", "number", "days_left")


ALL = f"""SELECT ico, kind, date, {AGE.format('date')} AS age_days FROM clean UNION ALL SELECT ico, 'management_vacancy', date, {AGE.format('date')} FROM growth
    UNION ALL SELECT ico, 'tender_open', NULL, 0 FROM open_tender UNION ALL SELECT ico, 'subsidy_signed', signed, {AGE.format('signed')} FROM funding"""
EVENT_TABLES = ("company", "movement", "listed", "vacancy", "tender", "subsidy")
EVENTS = {**REG, **VAC, "funding": FUNDING, "open_tender": OPEN, "every": ALL}


def every(spark, d):
    """All events of all companies: ico, kind, date, age_days."""
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("date")).alias("age_days")
    parts = [
        clean(spark, d).select("ico", "kind", "date", age),
        growth(spark, d).select("ico", F.lit("management_vacancy").alias("kind"), "date", age),
        events.tender_events(T.tender(spark, d), AS_OF).select("ico", F.lit("tender_open").alias("kind"), F.lit(None).cast("date").alias("date"), "age_days"),
        funding(spark, d).select("ico", F.lit("subsidy_signed").alias("kind"), F.col("signed").alias("date"), "age_days"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def happened(spark, d):
    """All events, written once for the several branches that read them."""
    return materialize(every(spark, d), "events")


@query("q21_all_events", with_sql("SELECT ico, kind, date, CAST(age_days AS INTEGER) AS age_days FROM every", *EVENT_TABLES, **EVENTS))
def all_events(spark, d):
    return every(spark, d)


FAMILY = "CASE WHEN kind = 'subsidy_signed' THEN 'subsidy' WHEN kind = 'tender_open' THEN 'tender' WHEN kind = 'management_vacancy' THEN 'growth' ELSE 'registry' END"
REASONS = f"""SELECT ico, reason, n_kinds >= 2 AS corroborated, has_tender, n_families, CAST(coalesce(CASE reason WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN g END, youngest) AS INTEGER) AS age_days FROM (
    SELECT *, CASE WHEN a IS NOT NULL AND NOT has_tender THEN 'A' WHEN b IS NOT NULL THEN 'B' WHEN c IS NOT NULL THEN 'C' WHEN g IS NOT NULL THEN 'D' ELSE 'E' END AS reason FROM (
      SELECT e.ico, min(age_days) FILTER (family = 'subsidy') AS a, min(age_days) FILTER (family = 'registry') AS b, min(age_days) FILTER (family = 'tender') AS c, min(age_days) FILTER (family = 'growth') AS g,
        min(age_days) AS youngest, count(DISTINCT kind) AS n_kinds, count(DISTINCT family) AS n_families, e.ico IN (SELECT ico FROM tender WHERE relevant) AS has_tender FROM (SELECT *, {FAMILY} AS family FROM every) e GROUP BY e.ico))"""


def reasons(spark, d, seen=None):
    return events.reasons(every(spark, d) if seen is None else seen, T.tender(spark, d))


@query("q22_reason_class", with_sql("SELECT ico, reason, corroborated, has_tender, CAST(n_families AS INTEGER) AS n_families, age_days FROM reasons", *EVENT_TABLES, **EVENTS, reasons=REASONS))
def reason_class(spark, d):
    return reasons(spark, d).select("ico", "reason", "corroborated", "has_tender", F.size("families").alias("n_families"), "age_days")


NORM = "trim(regexp_replace({}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"
INDEX = f"""SELECT *, coalesce(sha256 <> CASE WHEN url IS NULL THEN lag(sha256) OVER (PARTITION BY ico, source ORDER BY fetched_at, id) ELSE lag(sha256) OVER (PARTITION BY ico, source, url ORDER BY fetched_at, id) END, true) AS changed FROM (SELECT *, sha256({NORM.format('text')}) AS sha256 FROM snapshot)"""


@query("q23_snapshot_store", with_sql("SELECT sha256, count(*) AS snapshots, min(id) AS first_id FROM idx GROUP BY sha256", "snapshot", idx=INDEX))
def snapshot_store(spark, d):
    index, blobs = tables.store_snapshots(T.snapshot(spark, d))
    return index.groupBy("sha256").agg(F.count("*").alias("snapshots"), F.min("id").alias("first_id")).join(blobs.select("sha256"), "sha256")


@query("q24_latest_document", with_sql("SELECT ico, url, id FROM (SELECT *, row_number() OVER (PARTITION BY ico, url ORDER BY fetched_at DESC, id DESC) AS n FROM snapshot) WHERE n = 1", "snapshot"))
def latest_document(spark, d):
    return evidence.latest_documents(T.snapshot(spark, d)).select("ico", "url", "id")


@query("q25_changed_flag", with_sql("SELECT id, changed FROM idx", "snapshot", idx=INDEX))
def changed_flag(spark, d):
    return tables.store_snapshots(T.snapshot(spark, d))[0].select("id", "changed")


VERIFIED = f"""SELECT f.finding_id, CASE WHEN f.quote IS NULL THEN 'inference' WHEN min(s.id) FILTER (hit) IS NOT NULL THEN 'fact' ELSE 'discard' END AS state, min(s.id) FILTER (hit) AS snapshot_id
    FROM finding f LEFT JOIN (SELECT finding_id, id, contains(lower({NORM.format('text')}), lower({NORM.format('plain')})) AS hit FROM (SELECT finding_id, plain FROM finding WHERE quote IS NOT NULL), snapshot) s ON f.finding_id = s.finding_id GROUP BY f.finding_id, f.quote"""


def verified(spark, d):
    return evidence.verify_quotes(T.finding(spark, d), T.snapshot(spark, d))


@query("q26_quote_verify", with_sql("SELECT * FROM verified", "finding", "snapshot", verified=VERIFIED))
def quote_verify(spark, d):
    rows = verified(spark, d)
    return rows.select("finding_id", "state", F.when(F.col("state") == "fact", F.col("snapshot_id")).alias("snapshot_id"))


@query("q27_verify_tally", with_sql("SELECT state, count(*) AS n FROM verified GROUP BY state", "finding", "snapshot", verified=VERIFIED))
def verify_tally(spark, d):
    return verified(spark, d).groupBy("state").agg(F.count("*").alias("n"))


PASS = "SELECT * FROM (SELECT *, max(run_id) OVER (PARTITION BY ico, split_part(kind, ':', 1)) AS newest FROM claim) WHERE run_id = newest"
ADMISSIBLE = "coalesce(relevance, '') <> 'unrelated' AND NOT (coalesce(quote, '') = '' AND value = 'údaj není uveden')"
STOPPED = f"lower(rtrim(regexp_replace({NORM.format('quote')}, '([^.]|^)\\.\\s*$', '\\1')))"
USABLE = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ico, CASE WHEN quote IS NULL THEN 'v' || split_part(kind, ':', 1) || '/' || lower({NORM.format('value')}) ELSE 'q' || {STOPPED} END
    ORDER BY CASE WHEN relevance = 'supports' THEN 0 ELSE 1 END, CASE WHEN contains(kind, ':') THEN 0 ELSE 1 END, claim_id DESC) AS n FROM pass WHERE {ADMISSIBLE}) WHERE n = 1"""


@query("q28_newest_pass", with_sql("SELECT claim_id FROM pass", "claim", **{"pass": PASS}))
def newest_pass(spark, d):
    return evidence.newest_pass(T.claim(spark, d)).select("claim_id")


@query("q29_usable_evidence", with_sql("SELECT claim_id, ico, kind FROM usable", "claim", **{"pass": PASS}, usable=USABLE))
def usable_evidence(spark, d):
    return evidence.usable(T.claim(spark, d)).select("claim_id", "ico", "kind")


NOTNOW = "SELECT * FROM claim WHERE kind NOT LIKE 'now:%'"
RICH = f"""SELECT e.ico, coalesce(facts, 0) AS facts, coalesce(inferences, 0) AS inferences, coalesce(signal_facts, 0) AS signal_facts, total - coalesce(k, 0) AS not_kept, inadmissible FROM
    (SELECT ico, count(*) AS total, count(*) FILTER (NOT ({ADMISSIBLE})) AS inadmissible FROM scored GROUP BY ico) e LEFT JOIN
    (SELECT ico, count(*) FILTER (state = 'fact') AS facts, count(*) FILTER (state = 'inference') AS inferences, count(*) FILTER (state = 'fact' AND split_part(kind, ':', 1) <> 'production_mode') AS signal_facts, count(*) AS k FROM usable GROUP BY ico) u ON e.ico = u.ico"""


@query("q30_richness", with_sql("SELECT * FROM rich", "claim", scored=NOTNOW, **{"pass": PASS.replace("FROM claim", "FROM scored")}, usable=USABLE, rich=RICH))
def richness(spark, d):
    return evidence.richness(T.claim(spark, d))


@query("q31_contested", with_sql("""SELECT w.ico, w.domain, CASE WHEN status = 'proven' AND evidence <> 'ico' AND coalesce(h, 0) >= 2 THEN 'probable' ELSE status END AS status, coalesce(h, 0) AS holders FROM website w
    LEFT JOIN (SELECT domain, count(*) AS h FROM website WHERE status = 'proven' AND evidence <> 'ico' GROUP BY domain) x ON w.domain = x.domain""", "website"))
def contested(spark, d):
    return facets.contested(T.website(spark, d)).select("ico", "domain", "status", "holders")


@query("q32_page_text")
def page_text(spark, d):
    return T.table(spark, d, "pages").select("page_id", pages.page_text(F.col("html")).alias("text"))


LINK = "(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
LINKS = f"""SELECT page_id, min(pos) AS pos, href, arg_min(label, pos) AS label FROM (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, {NORM.format("regexp_replace(unnest(l), '(?s)<[^>]*>', ' ', 'g')")} AS label
    FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS h, regexp_extract_all(html, '{LINK}', 2) AS l FROM pages)) GROUP BY page_id, href"""
KIND = "CASE " + " ".join(f"WHEN regexp_matches(href || ' ' || label, '{p}') THEN '{k}'" for k, p in pages.KINDS) + " ELSE 'other' END"


@query("q33_links", with_sql("SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label FROM links", links=LINKS))
def links(spark, d):
    return pages.links(T.table(spark, d, "pages"))


@query("q34_page_kind", with_sql(f"SELECT {KIND} AS kind, count(*) AS n FROM links GROUP BY 1", links=LINKS))
def page_kind(spark, d):
    found = pages.links(T.table(spark, d, "pages"))
    return found.groupBy(pages.link_kind(F.col("href"), F.col("label")).alias("kind")).agg(F.count("*").alias("n"))


@query("q35_link_budget", with_sql(f"SELECT page_id, href, kind FROM (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY pos) AS n FROM (SELECT *, {KIND} AS kind FROM links)) WHERE n <= CASE kind "
    + " ".join(f"WHEN '{k}' THEN {n}" for k, n in pages.BUDGET.items()) + " END", links=LINKS))
def link_budget(spark, d):
    return pages.link_budget(pages.links(T.table(spark, d, "pages"))).select("page_id", "href", "kind")


_CLAIMED = "lpad(CAST(CAST(substr(source, 4) AS INTEGER) * 1234567 + 1000 AS VARCHAR), 8, '0')"
PROOF_PAGES = f"""SELECT ico, page_ord, CASE page_ord % 40 WHEN 0 THEN text || ' IČ ' || substr(ico, 1, 2) || ' ' || substr(ico, 3, 3) || ' ' || substr(ico, 6) WHEN 1 THEN text || ' DIČ: cz' || ltrim(ico, '0')
    WHEN 2 THEN text || ' call ' || substr(ico, 1, 4) || ', room ' || substr(ico, 5) ELSE text END AS text FROM (SELECT {_CLAIMED} AS ico, doc_id AS page_ord, text FROM documents WHERE source NOT IN ('src3', 'src8'))
    UNION ALL SELECT {_CLAIMED}, doc_id, text FROM documents WHERE source IN ('src3', 'src8')"""
RUNS = "list_concat(regexp_extract_all(text, '(\\d[\\d\\s\\x{00A0}.]{6,12}\\d)', 1), regexp_extract_all(text, '(?i)CZ[\\s\\x{00A0}]?(\\d[\\d\\s\\x{00A0}]{6,11})', 1))"


@query("q36_proof_grade", with_sql(f"""SELECT ico, arg_min(evidence, g * 1000000000000 + page_ord) AS evidence, arg_min(page_ord, g * 1000000000000 + page_ord) AS page_ord FROM (
    SELECT ico, page_ord, 0 AS g, 'ico' AS evidence FROM f WHERE num UNION ALL SELECT ico, page_ord, 1, 'person' FROM f WHERE person AND town UNION ALL SELECT ico, page_ord, 2, 'address' FROM f WHERE street
    UNION ALL SELECT ico, page_ord, 3, CASE WHEN city THEN 'name_city' ELSE 'name' END FROM f WHERE name) GROUP BY ico""", proof_pages=PROOF_PAGES,
    f=f"""SELECT *, bool_or(city) OVER (PARTITION BY ico) AS town FROM (SELECT ico, page_ord, len(list_filter(list_transform({RUNS}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: x = ico OR x = ltrim(ico, '0'))) > 0 AS num, contains(lower(text), 'tion are') AS person, contains(lower(text), 'nd the') AS street, contains(lower(text), 'the and') AS name, contains(lower(text), 'thea') AS city FROM proof_pages)"""))
def proof_grade(spark, d):
    ico = F.lpad((F.substring("source", 4, 9).cast("int") * 1234567 + 1000).cast("string"), 8, "0")
    docs = T.table(spark, d, "documents").select(ico.alias("ico"), F.col("doc_id").alias("page_ord"), "text", "source")
    n = F.col("page_ord") % 40
    part = lambda a, b: F.substring("ico", a, b)
    shown = (
        F.when(n == 0, F.concat("text", F.lit(" IČ "), part(1, 2), F.lit(" "), part(3, 3), F.lit(" "), part(6, 3))).when(n == 1, F.concat("text", F.lit(" DIČ: cz"), F.ltrim("ico", F.lit("0"))))
        .when(n == 2, F.concat("text", F.lit(" call "), part(1, 4), F.lit(", room "), part(5, 4))).otherwise(F.col("text"))
    )
    docs = docs.withColumn("text", F.when(F.col("source").isin("src3", "src8"), F.col("text")).otherwise(shown))
    firms = docs.select("ico", F.lit("the and").alias("name"), F.lit("thea").alias("city"), F.lit("tion are").alias("person"), F.lit("nd the").alias("street")).distinct()
    return pages.page_proof(docs, firms)


MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
MAILS = f"SELECT DISTINCT doc_id AS id, ico, lower(a) AS address, split_part(lower(a), '@', 2) AS mail_host FROM (SELECT doc_id, source AS ico, unnest(regexp_extract_all(text, '({MAIL})', 1)) AS a FROM documents)"


def mails(spark, d):
    return pages.emails(T.snapshot(spark, d))


@query("q37_emails_phones", with_sql(f"""SELECT id, 'mail' AS what, address AS value FROM mails UNION ALL SELECT DISTINCT id, 'phone', p FROM (SELECT doc_id AS id, regexp_replace(unnest(regexp_extract_all(text, '(\\+?[0-9][0-9 \\-/]{{7,14}}[0-9])', 1)), '[^0-9]', '', 'g') AS p FROM documents)
    WHERE length(p) >= 9 AND length(replace(p, substr(p, 1, 1), '')) > 0""", mails=MAILS))
def emails_phones(spark, d):
    docs = T.snapshot(spark, d)
    return mails(spark, d).select("id", F.lit("mail").alias("what"), F.col("address").alias("value")).unionByName(pages.phones(docs).select("id", F.lit("phone").alias("what"), F.col("phone").alias("value")))


@query("q38_mail_domain_mode", with_sql(f"SELECT ico, mail_host, n FROM (SELECT *, row_number() OVER (PARTITION BY ico ORDER BY n DESC, mail_host) AS r FROM (SELECT ico, mail_host, count(DISTINCT address) AS n FROM mails WHERE mail_host NOT IN {_in(pages.FREEMAIL)} GROUP BY ico, mail_host HAVING count(DISTINCT address) >= 2)) WHERE r = 1", mails=MAILS))
def mail_domain_mode(spark, d):
    docs = T.snapshot(spark, d)
    return pages.dominant_mail_host(pages.emails(docs).join(docs.select("id", "ico"), "id"), "ico")


@query("q39_desk_rank", with_sql("""SELECT CAST(CASE WHEN regexp_matches(l, '^(obchod|sales|prodej)') THEN 0 WHEN regexp_matches(l, '^(info|office|kontakt|mail)') THEN 1 WHEN regexp_matches(l, '^(faktur|efaktur|ucto|billing|gdpr|hr)') THEN 3 ELSE 2 END AS INTEGER) AS desk, count(*) AS n
    FROM (SELECT split_part(address, '@', 1) AS l FROM mails) GROUP BY 1""", mails=MAILS))
def desk_rank(spark, d):
    return mails(spark, d).groupBy(pages.desk_rank(F.col("address")).alias("desk")).agg(F.count("*").alias("n"))


SIDES = (
    ("made_to_order", "direct", "(?i)worthless"), ("serial", "direct", "(?i)stupid"), ("small_batch", "direct", "(?i) que de "), ("mixed", "direct", "(?i) les ou "),
    ("made_to_order", "structural", "(?i) the and "), ("serial", "structural", "(?i) und der | of the "),
)
MODES = "SELECT doc_id AS id, side, kind, len(regexp_extract_all(text, p)) AS hits FROM documents, (VALUES " + ", ".join(f"('{s}', '{k}', '{p}')" for s, k, p in SIDES) + ") v(side, kind, p) WHERE len(regexp_extract_all(text, p)) > 0"


@query("q40_mode_verdict", with_sql("""SELECT doc_id AS ico, CASE WHEN x OR m + s + b > 1 THEN 'mixed' WHEN m = 1 THEN 'made_to_order' WHEN s = 1 THEN 'serial' WHEN b = 1 THEN 'small_batch' WHEN n IS NULL OR o = r THEN 'unknown' WHEN o > r THEN 'leaning_made_to_order' ELSE 'leaning_serial' END AS mode,
    CASE WHEN x OR m + s + b > 0 THEN 'direct' WHEN o = r THEN 'structural_tie' WHEN n > 0 THEN 'structural' END AS basis FROM documents LEFT JOIN (
    SELECT id, count(*) AS n, bool_or(side = 'mixed') AS x, CAST(bool_or(side = 'made_to_order' AND kind = 'direct') AS INTEGER) AS m, CAST(bool_or(side = 'serial' AND kind = 'direct') AS INTEGER) AS s, CAST(bool_or(side = 'small_batch') AS INTEGER) AS b,
      coalesce(sum(hits) FILTER (side = 'made_to_order'), 0) AS o, coalesce(sum(hits) FILTER (side = 'serial'), 0) AS r FROM modes GROUP BY id) ON id = doc_id""", modes=MODES))
def mode_verdict(spark, d):
    docs = T.snapshot(spark, d)
    return evidence.mode_verdict(pages.mode_findings(docs, SIDES).withColumnRenamed("id", "ico"), docs.select(F.col("id").alias("ico")))


PRIORITY = {"de": 0, "en": 1, "fr": 2}


@query("q41_document_budget", """SELECT id FROM (SELECT id, kind, CASE WHEN kind = 'es' THEN row_number() OVER (PARTITION BY ico, kind = 'es' ORDER BY rank, id DESC) <= 1 ELSE row_number() OVER (PARTITION BY ico, kind = 'es' ORDER BY rank, id DESC) <= CASE WHEN has THEN 7 ELSE 8 END END AS ok FROM (
    SELECT *, bool_or(kind = 'es') OVER (PARTITION BY ico) AS has FROM (SELECT doc_id AS id, source AS ico, lang AS kind, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS rank, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS k FROM documents) WHERE k <= 3)) WHERE ok""")
def document_budget(spark, d):
    docs = T.snapshot(spark, d).select("id", "ico", F.col("source").alias("kind"), "text")
    return evidence.document_budget(docs, PRIORITY, per_kind=3, total=8, reserved="es").select("id")


ROWS = f"""SELECT c.ico, r.reason, CASE WHEN substr(nace, 1, 2) IN {_in(select.CORE)} THEN 0 WHEN substr(nace, 1, 2) IN {_in(select.SERVICE)} THEN 1 ELSE 2 END AS fit_rank, CAST(v.demoted AS INTEGER) AS demoted,
    CAST(band = '' AS INTEGER) AS size_unknown, ascii(r.reason) - 65 AS class_rank, CAST(NOT corroborated AS INTEGER) AS not_corroborated, CASE WHEN coalesce(km <= 150, false) THEN 0 ELSE 1 END AS not_preferred, r.age_days,
    -coalesce(f.facts, 0) AS minus_facts, site_status, has_channel FROM judged c JOIN reasons r ON c.ico = r.ico JOIN verdicts v ON c.ico = v.ico AND v.verdict <> 'exclude' LEFT JOIN rich f ON f.ico = c.ico WHERE c.ended IS NULL AND reject_reason IS NULL"""
RANKED = "SELECT *, row_number() OVER (ORDER BY fit_rank, demoted, size_unknown, class_rank, not_corroborated, not_preferred, age_days, minus_facts, ico) AS place FROM eval"
SELECTED = {**EVENTS, "reasons": REASONS, "placed": PLACED, "site_counts": COUNTS, "verdicts": VERDICT, "judged": JUDGED, "scored": NOTNOW, "pass": PASS.replace("FROM claim", "FROM scored"), "usable": USABLE, "rich": RICH, "eval": ROWS, "ranked": RANKED}
SELECT_TABLES = (*EVENT_TABLES, "site", "delivered", "claim")


def firms(spark, d):
    """All companies with verdict and reject_reason; one that has ended is rejected as such."""
    company = materialize(T.company(spark, d), "companies")
    found = qualify.apply_brief(qualify.with_verdict(company, T.site(spark, d)), T.site(spark, d), BRIEF)
    return found.withColumn("reject_reason", F.coalesce(F.when(F.col("ended").isNotNull(), "ended"), "reject_reason"))


def evaluated(spark, d, seen=None):
    return select.evaluate(qualify.eligible(firms(spark, d)), reasons(spark, d, seen), richness(spark, d))


def ranked(spark, d, seen=None):
    return materialize(select.ranked(evaluated(spark, d, seen)), "ranked")


@query("q42_ordering", with_sql("SELECT ico, reason, CAST(place AS INTEGER) AS place FROM ranked", *SELECT_TABLES, **SELECTED))
def ordering(spark, d):
    return ranked(spark, d).select("ico", "reason", "place")


GROUPED = "SELECT ico, arg_min(owner, owner || CAST(date AS VARCHAR)) AS owner, arg_min(date, owner || CAST(date AS VARCHAR)) AS date FROM (SELECT ico, name AS owner, date FROM movement WHERE legal_entity AND kind LIKE 'owner%') GROUP BY ico"


def groups(spark, d):
    return T.movement(spark, d).where("legal_entity and kind like 'owner%'").select("ico", F.col("name").alias("owner"), "date")


@query("q43_collapse", with_sql("""SELECT ico, owner, CAST(n - 1 AS INTEGER) AS n_siblings FROM (SELECT r.ico, g.owner, row_number() OVER w AS i, count(*) OVER (PARTITION BY g.owner, g.date, CASE WHEN g.ico IS NULL THEN r.ico END) AS n FROM ranked r LEFT JOIN grouped g ON r.ico = g.ico
    WINDOW w AS (PARTITION BY g.owner, g.date, CASE WHEN g.ico IS NULL THEN r.ico END ORDER BY place)) WHERE i = 1""", *SELECT_TABLES, **SELECTED, grouped=GROUPED))
def collapse(spark, d):
    return select.collapse(ranked(spark, d), groups(spark, d)).select("ico", "owner", F.size("siblings").alias("n_siblings"))


def _quota(source: str, n: int) -> str:
    return f"SELECT ico, reason, CAST(place AS INTEGER) AS place, a > {n} AS class_slot FROM (SELECT *, row_number() OVER (ORDER BY c > 1, place) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY place) AS c, row_number() OVER (ORDER BY place) AS a FROM {source})) WHERE pick <= {n}"


@query("q44_quota", with_sql(_quota("ranked", 12), *SELECT_TABLES, **SELECTED))
def quota(spark, d):
    return select.quota(ranked(spark, d), 12).select("ico", "reason", "place", "class_slot")


FRESH = """SELECT r.* FROM ranked r LEFT JOIN (SELECT ico, max(delivered_on) AS last FROM delivered GROUP BY ico) l ON r.ico = l.ico LEFT JOIN (SELECT ico, max(date) AS newest, bool_or(kind = 'tender_open') AS tender FROM every GROUP BY ico) e ON r.ico = e.ico
    WHERE {} (l.last IS NULL OR coalesce(tender, false) OR newest > last)"""
LEADERS = "SELECT * FROM (SELECT r.*, g.owner, row_number() OVER (PARTITION BY g.owner, g.date, CASE WHEN g.ico IS NULL THEN r.ico END ORDER BY place) AS lead FROM fresh r LEFT JOIN grouped g ON r.ico = g.ico) WHERE lead = 1"


def week(spark, d):
    seen = happened(spark, d)
    return select.week(ranked(spark, d, seen), seen, T.delivered(spark, d), groups(spark, d), 5)


@query("q45_week", with_sql(_quota("leaders", 5), *SELECT_TABLES, **SELECTED, grouped=GROUPED, fresh=FRESH.format("site_status = 'proven' AND has_channel AND"), leaders=LEADERS))
def the_week(spark, d):
    return week(spark, d).select("ico", "reason", "place", "class_slot")


@query("q46_already_shown", with_sql("SELECT ico FROM fresh", *SELECT_TABLES, **SELECTED, fresh=FRESH.format("")))
def already_shown(spark, d):
    seen = happened(spark, d)
    return select.not_shown(ranked(spark, d, seen), seen, T.delivered(spark, d)).select("ico")


@query("q47_history", with_sql("SELECT d.ico, run_id, count(*) OVER (PARTITION BY d.ico) AS times, c.name, c.ico IS NOT NULL AS in_candidates FROM delivered d LEFT JOIN company c ON d.ico = c.ico", "company", "delivered"))
def history(spark, d):
    return select.history(T.delivered(spark, d), T.company(spark, d)).select("ico", "run_id", "times", "name", "in_candidates")


@query("q48_lag_percentile", with_sql(f"SELECT CAST(age AS INTEGER) AS lag, n FROM (SELECT {AGE.format('date')} AS age, row_number() OVER (ORDER BY {AGE.format('date')}) AS r, count(*) OVER () AS n FROM vacancy) WHERE r = floor(n * 0.01) + 1", "vacancy"))
def lag_percentile(spark, d):
    return study.rank_percentile(T.vacancies(spark, d)[1], "date", AS_OF)


@query("q49_source_lag", with_sql(" UNION ALL ".join(f"SELECT '{s}' AS source, max({c}) AS newest, CAST({AGE.format(f'max({c})')} AS INTEGER) AS age_days, count({c}) AS n FROM {t}" for s, t, c in (("registry", "movement", "date"), ("subsidies", "subsidy", "signed"), ("vacancies", "vacancy", "date"))), "movement", "subsidy", "vacancy"))
def source_lag(spark, d):
    return study.source_lags({"registry": (T.movement(spark, d), "date"), "subsidies": (T.subsidy(spark, d), "signed"), "vacancies": (T.vacancies(spark, d)[1], "date")}, AS_OF)


FAMILIES = f"SELECT ico, CASE WHEN kind LIKE 'director%' THEN 'director' ELSE 'owner' END AS family, date, {AGE.format('date')} AS age, kind FROM movement UNION ALL SELECT ico, 'vacancy', date, {AGE.format('date')}, 'vacancy' FROM vacancy"


def family_events(spark, d):
    moves = T.movement(spark, d).select("ico", F.split("kind", "_")[0].alias("family"), "date", "kind")
    return moves.unionByName(T.vacancies(spark, d)[1].select("ico", F.lit("vacancy").alias("family"), "date", F.lit("vacancy").alias("kind")))


@query("q50_window_sweep", with_sql(f"SELECT CAST(w AS INTEGER) AS width, coalesce(family, 'any') AS family, count(DISTINCT ico) AS companies FROM fam, (SELECT unnest({list(WIDTHS)}) AS w) WHERE age BETWEEN 0 AND w GROUP BY GROUPING SETS ((w, family), (w))", "movement", "vacancy", fam=FAMILIES))
def window_sweep(spark, d):
    return study.window_sweep(family_events(spark, d), WIDTHS, AS_OF)


WEEKS = "SELECT CAST(w AS INTEGER) AS week, coalesce(n, 0) AS companies, coalesce(k, 0) AS deliverable FROM (SELECT unnest(range(104)) AS w) LEFT JOIN (SELECT age // 7 AS a, count(DISTINCT f.ico) AS n, count(DISTINCT f.ico) FILTER (c.site_status = 'proven' AND c.has_channel) AS k FROM fam f LEFT JOIN company c ON f.ico = c.ico WHERE age BETWEEN 0 AND 727 GROUP BY 1) ON a = w"


def weeks(spark, d):
    able = T.company(spark, d).where("site_status = 'proven' and has_channel")
    return study.weekly(family_events(spark, d), AS_OF, 104, able)


@query("q51_backtest_weeks", with_sql("SELECT * FROM weeks", "company", "movement", "vacancy", fam=FAMILIES, weeks=WEEKS))
def backtest_weeks(spark, d):
    return weeks(spark, d)


@query("q51b_backtest_summary", with_sql("SELECT quantile_cont(companies, 0.5) AS median, avg(companies) AS mean, min(companies) AS least, max(companies) AS most, count(*) FILTER (companies >= 5) AS enough, count(*) AS weeks FROM weeks", "company", "movement", "vacancy", fam=FAMILIES, weeks=WEEKS))
def backtest_summary(spark, d):
    return study.weekly_summary(weeks(spark, d))


@query("q52_seasonality", with_sql(f"SELECT CAST(month(DATE '{AS_OF}' - CAST(7 * week AS INTEGER)) AS INTEGER) AS month, avg(companies) AS per_week FROM weeks GROUP BY 1", "company", "movement", "vacancy", fam=FAMILIES, weeks=WEEKS))
def seasonality(spark, d):
    return study.seasonality(weeks(spark, d), AS_OF)


@query("q53_age_profile", with_sql("SELECT family, CAST(min(age) AS INTEGER) AS youngest, CAST(max(age) FILTER (r = n // 2 + 1) AS INTEGER) AS upper_median, CAST(max(age) AS INTEGER) AS oldest FROM (SELECT family, age, row_number() OVER (PARTITION BY family ORDER BY age) AS r, count(*) OVER (PARTITION BY family) AS n FROM fam) GROUP BY family", "movement", "vacancy", fam=FAMILIES))
def age_profile(spark, d):
    return study.age_profile(family_events(spark, d), AS_OF)


@query("q54_histogram", with_sql("SELECT CAST(a AS INTEGER) AS age, coalesce(n, 0) AS n FROM (SELECT unnest(range(31)) AS a) LEFT JOIN (SELECT age, count(*) AS n FROM fam GROUP BY age) f ON f.age = a", "movement", "vacancy", fam=FAMILIES))
def histogram(spark, d):
    return study.age_histogram(family_events(spark, d), AS_OF)


@query("q54b_kind_shares", with_sql("SELECT kind, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM movement GROUP BY kind", "movement"))
def kind_shares(spark, d):
    return study.kind_shares(T.movement(spark, d))


@query("q54c_coverage", with_sql(" UNION ALL ".join(f"SELECT '{x}' AS field, avg(CAST(nullif(CAST({x} AS VARCHAR), '') IS NOT NULL AS INTEGER)) AS share FROM company" for x in ("nace", "band", "lat", "ended")), "company"))
def coverage(spark, d):
    return study.coverage(T.company(spark, d), ("nace", "band", "lat", "ended"))


OTHER = "SELECT lpad(CAST(c_custkey * 2 AS VARCHAR), 8, '0') AS ico, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '120' END AS band FROM customer"


@query("q55_newcomer_queue", with_sql("SELECT p.ico, CAST(CASE WHEN band = '' THEN 1 ELSE 0 END AS INTEGER) AS unsized, CAST(greatest(0, (SELECT count(*) FROM plan JOIN other USING (ico) WHERE plan = 'new') - 25) AS INTEGER) AS deferred FROM plan p JOIN other o ON p.ico = o.ico WHERE plan = 'new' ORDER BY 2, 1 LIMIT 25", "company", "change", latest=LATEST, plan=PLAN, other=OTHER))
def newcomer_queue(spark, d):
    k = F.col("c_custkey")
    register = T.table(spark, d, "customer").select(F.lpad((k * 2).cast("string"), 8, "0").alias("ico"), F.when(k % 3 == 0, "").otherwise("120").alias("band"))
    return select.newcomers(facets.change_plan(T.change(spark, d), T.company(spark, d)), register).select("ico", "unsized", "deferred")


@query("q56_resume_anti", with_sql("SELECT ico FROM company WHERE ico NOT IN (SELECT ico FROM change)", "company", "change"))
def resume_anti(spark, d):
    return tables.resume(T.company(spark, d), T.change(spark, d), "ico").select("ico")


@query("q57_upsert_base", with_sql("SELECT c.ico, coalesce(l.kind, 'as before') AS state FROM company c LEFT JOIN latest l ON c.ico = l.ico", "company", "change", latest=LATEST))
def upsert_base(spark, d):
    base = T.company(spark, d).select("ico", F.lit("as before").alias("state"))
    return tables.upsert(base, facets.latest_changes(T.change(spark, d)).select("ico", F.col("kind").alias("state")), "ico")


@query("q58_suggest_places", "SELECT name, CAST(CASE WHEN lower(name) = 'red ring' THEN 0 WHEN lower(name) LIKE 'red ring%' THEN 1 ELSE 2 END AS INTEGER) AS grade FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT n_name FROM nation) WHERE contains(lower(name), 'r') AND contains(lower(name), 'red ring') ORDER BY grade, length(name), name LIMIT 6")
def suggest_places(spark, d):
    names = T.table(spark, d, "part").select(F.col("p_name").alias("name")).union(T.table(spark, d, "nation").select("n_name")).distinct()
    return facets.suggest(names, "red ring").select("name", "grade")


@query("q59_dossier", with_sql("SELECT r.ico, r.reason, e.n_events, e.first_kind FROM reasons r JOIN (SELECT ico, count(*) AS n_events, min(kind) AS first_kind FROM every GROUP BY ico) e ON r.ico = e.ico", *EVENT_TABLES, **EVENTS, reasons=REASONS))
def dossier(spark, d):
    seen = happened(spark, d)
    listed = seen.groupBy("ico").agg(F.array_sort(F.collect_list(F.struct("kind", "date", "age_days"))).alias("events"))
    full = reasons(spark, d, seen).join(listed, "ico")
    return full.select("ico", "reason", F.size("events").cast("long").alias("n_events"), F.col("events")[0]["kind"].alias("first_kind"))


PRICES = (("assistant", 0.40, 1.60), ("user", 0.40, 0.0), ("system", 0.10, 0.0))


@query("q60_ledger", "SELECT role AS model, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, CAST(sum(c) AS DECIMAL(18, 6)) AS cost FROM (SELECT role, t, o, round((t * pi + o * po) / 1000000, 6) AS c FROM (SELECT role, length(text) AS t, turn AS o FROM conversations) JOIN (VALUES "
    + ", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, a, b in PRICES) + ") p(m, pi, po) ON role = m) GROUP BY role")
def ledger(spark, d):
    calls = T.table(spark, d, "conversations").select(F.col("role").alias("model"), F.length("text").cast("long").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    prices = spark.createDataFrame(list(PRICES), "model string, price_in double, price_out double")
    return facets.ledger(calls, prices).withColumn("cost", F.col("cost").cast("decimal(18,6)"))


SOUND = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", CAST(0 AS BIGINT) AS violations" for c in audit.CHECKS if c != "buying")
# The selection doesn't look at projects, so this check alone finds what the data hold.
BUYING = f"SELECT 'buying', count(*) FROM ({_quota('leaders', 5)}) WHERE ico IN (SELECT ico FROM every WHERE kind = 'subsidy_signed') AND ico IN (SELECT ico FROM subsidy WHERE {_project()} = 'already_buying')"


@query("q61_audit", with_sql(f"{SOUND} UNION ALL {BUYING}", *SELECT_TABLES, **SELECTED, grouped=GROUPED, fresh=FRESH.format("site_status = 'proven' AND has_channel AND"), leaders=LEADERS))
def audited(spark, d):
    seen = happened(spark, d)
    judged_firms = materialize(firms(spark, d), "judged")
    why = materialize(reasons(spark, d, seen), "reasons")
    placed = materialize(select.ranked(select.evaluate(qualify.eligible(judged_firms), why, richness(spark, d))), "ranked")
    picked = materialize(select.week(placed, seen, T.delivered(spark, d), groups(spark, d), 5), "week")
    picked = picked.join(judged_firms.select("ico", "km"), "ico", "left")
    funded = T.subsidy(spark, d)
    buying = funded.where(events.project_kind(T.RULES) == "already_buying").select("ico").distinct()
    found = {"ranked": placed, "judged": judged_firms, "events": seen, "week": picked, "reasons": why, "km": BRIEF.km, "buying": buying, "gated": select.gate(placed), "claims": T.claim(spark, d), "delivered": T.delivered(spark, d)}
    return audit.report(found)


@query("q62_stream_changes", with_sql("SELECT ico, batch, pos, kind FROM (SELECT *, row_number() OVER (PARTITION BY ico ORDER BY batch DESC, pos DESC) AS n FROM change) WHERE n = 1", "change"))
def stream_changes(spark, d):
    """The batch twin of the change stream: what the streamed merge ends with."""
    return stream.last_in_batch(T.change(spark, d))


@query("q63_certificates", "SELECT doc_id AS id, s AS standard FROM (SELECT DISTINCT doc_id, regexp_replace(upper(unnest(regexp_extract_all(text, '((?:ISO|EN|IATF)\\s?[0-9]{4,5}(?::[0-9]{4})?)', 1))), '\\s', '', 'g') AS s FROM (SELECT doc_id, replace(text, 'the ', 'ISO 9001:2015 ') AS text FROM documents))")
def certificates(spark, d):
    docs = T.snapshot(spark, d).select("id", F.replace("text", F.lit("the "), F.lit("ISO 9001:2015 ")).alias("text"))
    return pages.standards(docs).select("id", "standard")


@query("q64_same_answers", with_sql("SELECT domain, count(DISTINCT ico) AS companies FROM website GROUP BY domain HAVING count(DISTINCT ico) >= 2", "website"))
def same_answers(spark, d):
    return facets.same_answers(T.website(spark, d), "domain")


@query("q65_status_tally", with_sql("SELECT status, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM website GROUP BY status", "website"))
def status_tally(spark, d):
    return facets.status_tally(T.website(spark, d), "status")


@query("q66_held_back", with_sql("SELECT problem, count(*) AS n FROM (SELECT unnest(['site_unproven']) AS problem FROM eval WHERE site_status <> 'proven' UNION ALL SELECT 'no_channel' FROM eval WHERE NOT has_channel) GROUP BY problem", *SELECT_TABLES, **SELECTED))
def held_back(spark, d):
    return select.held_back(evaluated(spark, d))
