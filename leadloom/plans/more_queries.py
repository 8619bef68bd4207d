"""Queries of dossiers, richness, relevance and contact pages, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import dossier, events, evidence, identity, pages, qualify, select
from leadloom.plans import catalogue as C
from leadloom.plans import fixtures as T
from leadloom.plans.catalogue import query
from leadloom.plans.fixtures import AS_OF, with_sql
from leadloom.sources import tables

SUBJECTS = ("dodávka ERP", "oprava střechy", "informační systém školy", "skladové regály", "plánování výroby")
_SUBJECT = "(?i)\\bERP\\b|\\bMES\\b|\\bWMS\\b|\\bAPS\\b|informa[cč]n[ií]\\s*syst[ée]m|[rř][ií]zen[ií]\\s*v[ýy]roby|pl[aá]nov[aá]n[ií]\\s*v[ýy]roby|v[ýy]robn[ií]\\s*syst[ée]m|termin[aá]l|[cč]árov[ée]\\s*k[oó]dy|sb[eě]r\\s*dat|dispe[cč]|sklado[vw]"
NOTICE = f"SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, o_orderkey AS number, lpad(CAST(o_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS cpv, ({T._list(SUBJECTS)})[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS name FROM orders"


@query("q86_relevant_tenders", with_sql(f"SELECT number, cpv LIKE '48%' OR cpv LIKE '72%' OR cpv LIKE '42961%' OR regexp_matches(name, '{_SUBJECT}') AS relevant FROM notice", notice=NOTICE))
def relevant_tenders(spark, d):
    k = F.col("o_orderkey")
    rows = T.table(spark, d, "orders").select(k.alias("number"), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0").alias("cpv"), F.get(F.array(*map(F.lit, SUBJECTS)), (k % 5).cast("int")).alias("name"))
    return events.with_relevance(rows).select("number", "relevant")


TITLES = "CASE " + " ".join("WHEN regexp_matches(lower(project), '\\b{}\\b') THEN '{}'".format(p.replace("\\b", ""), n) for n, p in T.RULES) + " ELSE 'other' END"


@query("q87_already_buying", with_sql(f"SELECT DISTINCT ico, project FROM subsidy WHERE {TITLES} = 'already_buying'", "subsidy"))
def already_buying(spark, d):
    return events.already_buying(T.subsidy(spark, d), T.RULES)


@query("q88_vacancy_texts", "SELECT ico, label, text FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'job ' || o_orderkey END, CAST(o_orderkey AS VARCHAR)) AS label, concat_ws(' ', CASE WHEN o_orderkey % 3 > 0 THEN 'job ' || o_orderkey END, CASE WHEN o_orderkey % 2 > 0 THEN o_orderpriority END) AS text FROM orders) WHERE text <> ''")
def vacancy_texts(spark, d):
    return events.vacancy_texts(postings(spark, d))


def postings(spark, d):
    """Postings; every third has no title, every second no text."""
    k = F.col("o_orderkey")
    title, text = F.when(k % 3 > 0, F.concat(F.lit("job "), k.cast("string"))).otherwise(" "), F.when(k % 2 > 0, F.col("o_orderpriority"))
    return T.table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), k.alias("id"), title.alias("title"), text.alias("text"))


@query("q89_vacancy_richness", "SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, count(*) AS vacancies, count(*) FILTER (o_orderkey % 2 > 0) AS vacancy_texts FROM orders GROUP BY 1")
def vacancy_richness(spark, d):
    return select.vacancy_richness(postings(spark, d))


@query("q90_kinds_per_window", with_sql(f"SELECT CAST(w AS INTEGER) AS width, kind, count(*) AS n FROM fam, (SELECT unnest({list(C.WIDTHS)}) AS w) WHERE age BETWEEN 0 AND w GROUP BY w, kind", "movement", "vacancy", fam=C.FAMILIES))
def kinds_per_window(spark, d):
    return events.kinds_per_window(C.family_events(spark, d), C.WIDTHS, AS_OF)


@query("q91_depth_cost", with_sql(f"SELECT CAST(w AS INTEGER) AS width, count(DISTINCT r.ico) AS companies, count(DISTINCT r.ico) FILTER (confidence IS NOT NULL) AS observed FROM (SELECT *, {C.AGE.format('date')} AS age FROM record) r JOIN depth d ON r.ico = d.ico, (SELECT unnest({list(C.WIDTHS)}) AS w) WHERE occupation IN {C._in(T.GROUPS)} AND age BETWEEN 0 AND w GROUP BY w", "vacancy", record=C.RECORD, depth=C.DEPTH))
def depth_cost(spark, d):
    return events.depth_cost(C.record(spark, d), T.GROUPS, C.WIDTHS, AS_OF)


@query("q92_already_known", with_sql("SELECT event_id FROM movement m WHERE kind = 'director_joined' AND EXISTS (SELECT 1 FROM movement o WHERE o.ico = m.ico AND lower(o.name) = lower(m.name) AND o.kind <> 'director_joined')", "movement"))
def already_known(spark, d):
    return events.already_known(T.movement(spark, d)).select("event_id")


@query("q93_unjudged", with_sql("SELECT claim_id FROM claim WHERE split_part(kind, ':', 1) = 'pain' AND state = 'fact' AND coalesce(quote, '') <> '' AND relevance IS NULL", "claim"))
def unjudged(spark, d):
    return evidence.unjudged(T.claim(spark, d)).select("claim_id")


@query("q94_judge_report", with_sql("SELECT ico, count(*) FILTER (relevance = 'supports') AS supports, count(*) FILTER (relevance = 'unrelated') AS unrelated, count(*) FILTER (relevance IS NULL) AS unjudged FROM claim WHERE split_part(kind, ':', 1) = 'pain' AND state = 'fact' GROUP BY ico", "claim"))
def judge_report(spark, d):
    return evidence.judge_report(T.claim(spark, d))


@query("q95_store_statistics", with_sql("SELECT count(*) AS snapshots, count(DISTINCT sha256) AS texts, count(DISTINCT ico) AS companies FROM idx", "snapshot", idx=C.INDEX))
def store_statistics(spark, d):
    return evidence.store_statistics(tables.store_snapshots(T.snapshot(spark, d))[0])


@query("q96_kind_spread", with_sql("SELECT kind, count(DISTINCT ico) AS companies, count(*) AS n FROM claim GROUP BY kind", "claim"))
def kind_spread(spark, d):
    return evidence.kind_spread(T.claim(spark, d))


SAID = "SELECT event_id AS claim_id, ico, 'now:' || kind AS kind, upper(name) || ' — odešel' AS value FROM movement"


@query("q97_contradicted", with_sql("SELECT claim_id FROM said s WHERE NOT (kind = 'now:director_departed' AND EXISTS (SELECT 1 FROM listed l WHERE l.ico = s.ico AND contains(lower(s.value), lower(l.name))))", "movement", "listed", said=SAID))
def contradicted(spark, d):
    said = T.movement(spark, d).select(F.col("event_id").alias("claim_id"), "ico", F.concat(F.lit("now:"), "kind").alias("kind"), F.concat(F.upper("name"), F.lit(" — odešel")).alias("value"))
    return evidence.contradicted(said, T.listed(spark, d)).select("claim_id")


@query("q98_turnover_pages", "SELECT doc_id AS id, 'Obrat ' || doc_id || ' mil. Kč' AS named FROM documents WHERE doc_id % 5 < 2")
def turnover_pages(spark, d):
    i = F.col("id")
    named = F.concat(F.lit(" Obrat "), i.cast("string"), F.lit(" mil. Kč"))
    docs = T.snapshot(spark, d).select("id", "ico", F.when(i % 5 < 2, F.concat("text", F.lit("."), named)).when(i % 5 == 2, F.concat("text", F.lit(" Obrat roste."))).otherwise(F.col("text")).alias("text"))
    return evidence.turnover_pages(docs).select("id", F.regexp_extract("excerpt", r"Obrat \d+ mil\. Kč", 0).alias("named"))


@query("q99_parked", "SELECT doc_id AS id, length(t) < 200 OR regexp_matches(substr(t, 1, 2000), '(?i)under construction|for sale') AS parked FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'Under Construction ' || text WHEN doc_id % 6 = 1 THEN 'Domain is for sale ' || text ELSE text END AS t FROM documents)")
def parked(spark, d):
    i = F.col("doc_id")
    text = F.when(i % 6 == 0, F.concat(F.lit("Under Construction "), "text")).when(i % 6 == 1, F.concat(F.lit("Domain is for sale "), "text")).otherwise(F.col("text"))
    return T.table(spark, d, "documents").select(i.alias("id"), pages.parked(text).alias("parked"))


LOCALS = ("info", "jan.novak", "efaktury", "sam-cl", "obchod.praha", "e")


@query("q100_personal_address", f"SELECT page_id AS id, a, a IN ('jan.novak', 'e') AS personal FROM (SELECT page_id, ({T._list(LOCALS)})[CAST(page_id % 6 + 1 AS INTEGER)] AS a FROM pages)")
def personal(spark, d):
    rows = T.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.get(F.array(*map(F.lit, LOCALS)), (F.col("page_id") % 6).cast("int")).alias("a"))
    return rows.select("id", "a", pages.personal_address(F.concat("a", F.lit("@sam-cl.cz")), F.lit("sam-cl.cz")).alias("personal"))


@query("q101_best_contact_page", "SELECT ico, arg_max(page_ord, s * 1000000000 - page_ord) AS page_ord, max(s) AS score FROM (SELECT source AS ico, doc_id AS page_ord, doc_id % 4 * 10 + n_chars % 7 AS s FROM documents) GROUP BY ico")
def best_contact_page(spark, d):
    rows = T.table(spark, d, "documents").select(F.col("source").alias("ico"), F.col("doc_id").alias("page_ord"), (F.col("doc_id") % 4).alias("reachable"), (F.col("n_chars") % 7).alias("channels"))
    return pages.best_contact_page(rows)


@query("q102_pool_counts", with_sql("SELECT count(*) AS total, count(*) FILTER (reject_reason IS NOT NULL) AS rejected, count(*) FILTER (reject_reason IS NULL AND verdict = 'exclude') AS excluded, count(*) FILTER (reject_reason IS NULL AND verdict <> 'exclude') AS pool FROM judged j JOIN verdicts v ON j.ico = v.ico", "company", "site", placed=C.PLACED, judged=C.JUDGED, site_counts=C.COUNTS, verdicts=C.VERDICT))
def pool_counts(spark, d):
    return select.pool_counts(qualify.apply_brief(qualify.with_verdict(T.company(spark, d), T.site(spark, d)), T.site(spark, d), C.BRIEF))


def reached(spark, d):
    """People of the register and of pages, with and without a channel."""
    i = F.col("event_id")
    return T.movement(spark, d).select("ico", F.when(i % 2 == 0, "register").otherwise("page").alias("source"), F.when(i % 3 == 0, "a@b.cz").alias("email"), F.when(i % 5 == 0, "123456789").alias("phone"))


CONTACTS = "SELECT coalesce(p.ico, c.ico) AS ico, coalesce(named_people, 0) AS named_people, coalesce(register_confirmed, 0) AS register_confirmed, coalesce(named_people, 0) > 0 OR c.ico IS NOT NULL AS any_channel FROM (SELECT ico, count(*) FILTER (event_id % 3 = 0 OR event_id % 5 = 0) AS named_people, count(*) FILTER ((event_id % 3 = 0 OR event_id % 5 = 0) AND event_id % 2 = 0) AS register_confirmed FROM movement GROUP BY ico) p FULL JOIN (SELECT ico FROM company WHERE has_channel) c ON p.ico = c.ico"


def contacts(spark, d):
    return select.contact_richness(reached(spark, d), T.company(spark, d).where("has_channel"))


@query("q103_contact_richness", with_sql("SELECT * FROM contacts", "company", "movement", contacts=CONTACTS))
def contact_richness(spark, d):
    return contacts(spark, d)


@query("q104_richness_score", with_sql("SELECT c.ico, CAST(coalesce(named_people, 0) + 5 * coalesce(register_confirmed, 0) + coalesce(vacancy_texts, 0) + coalesce(n, 0) AS BIGINT) AS richness FROM company c LEFT JOIN contacts k ON k.ico = c.ico LEFT JOIN (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, count(*) FILTER (o_orderkey % 2 > 0) AS vacancy_texts FROM orders GROUP BY 1) v ON v.ico = c.ico LEFT JOIN (SELECT ico, count(*) AS n FROM movement GROUP BY ico) m ON m.ico = c.ico", "company", "movement", contacts=CONTACTS))
def richness_score(spark, d):
    moved = T.movement(spark, d).groupBy("ico").agg(F.count("*").alias("events"))
    parts = T.company(spark, d).select("ico").join(contacts(spark, d), "ico", "left").join(select.vacancy_richness(postings(spark, d)), "ico", "left").join(moved, "ico", "left")
    return select.richness_score(parts).select("ico", "richness")


@query("q105_website_richness", with_sql("SELECT w.ico, CAST(CASE WHEN status = 'proven' THEN coalesce(p, 0) ELSE 0 END AS BIGINT) AS pages, CAST(CASE WHEN status = 'proven' THEN coalesce(h, 0) ELSE 0 END AS BIGINT) AS mode_findings FROM website w LEFT JOIN (SELECT lpad(CAST(doc_id % 100 AS VARCHAR), 8, '0') AS ico, count(DISTINCT source) AS p, sum(doc_id % 3) AS h FROM documents GROUP BY 1) d ON d.ico = w.ico", "website"))
def website_richness(spark, d):
    i = F.col("doc_id")
    docs = T.table(spark, d, "documents").select(F.lpad((i % 100).cast("string"), 8, "0").alias("ico"), F.col("source").alias("url"), (i % 3).alias("hits"))
    return select.website_richness(T.website(spark, d), docs)


SENTENCES = f"""SELECT ico, 'management_vacancy' AS kind, 'inzerát na řídící/plánovací roli, zveřejněno ' || date || ', firma inzeruje v ' || months || ' sledovaných měsících: ' || (SELECT title FROM record r WHERE r.ico = g.ico AND r.date = g.date AND r.occupation = g.occupation) AS said FROM growth g
    UNION ALL SELECT ico, 'tender_open', 'otevřená zakázka, do uzávěrky ' || days_left || ' dní: ' || number FROM open_tender
    UNION ALL SELECT ico, 'subsidy_signed', 'podepsaná dotace EU (' || printf('%.1f', CAST(total / 1000000 AS DOUBLE)) || ' mil. Kč), podepsáno ' || signed || CASE WHEN fresh THEN '' ELSE ' (starší, ověřit stav)' END || ': ' || project FROM funding
    UNION ALL SELECT ico, kind, name || ' — ' || CASE kind WHEN 'director_joined' THEN 'nastoupil do statutárního orgánu' WHEN 'director_departed' THEN 'opustil statutární orgán' WHEN 'owner_joined' THEN 'stal se vlastníkem' ELSE 'přestal být vlastníkem' END FROM clean"""


@query("q106_event_sentences", with_sql("SELECT ico, kind, said FROM sentences", *C.EVENT_TABLES, **C.EVENTS, sentences=SENTENCES))
def event_sentences(spark, d):
    return sentences(spark, d)


def sentences(spark, d):
    """Every event with its sentence: ico, kind, said."""
    columns = {"name": "string", "role": "string", "date": "date", "title": "string", "months": "long", "days_left": "int", "amount": "double", "fresh": "boolean"}

    def shaped(rows, kind, **have):
        return rows.select("ico", kind.alias("kind"), *[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    c = F.col
    parts = [
        shaped(C.growth(spark, d), F.lit("management_vacancy"), date=c("date"), title=c("title"), months=c("months")),
        shaped(events.tender_events(T.tender(spark, d), AS_OF), F.lit("tender_open"), title=c("number"), days_left=c("days_left")),
        shaped(C.funding(spark, d), F.lit("subsidy_signed"), date=c("signed"), title=c("project"), amount=c("total"), fresh=c("fresh")),
        shaped(C.clean(spark, d), c("kind"), name=c("name")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("ico", "kind", dossier.sentence().alias("said"))


STATUS = ("found", "scanned", "no_subject", "odd")


@query("q107_turnover_notes", f"SELECT ico, status, CASE WHEN status = 'found' THEN v END AS value_czk, CASE status WHEN 'scanned' THEN 'závěrka je sken bez textové vrstvy' WHEN 'no_subject' THEN 'není ve Sbírce listin' END AS note, CASE WHEN status = 'found' THEN 'fact' ELSE 'unknown' END AS state FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ico, c_custkey * 1000 AS v, CASE WHEN c_custkey % 5 = 4 THEN 'not_checked' ELSE ({T._list(STATUS)})[CAST(c_custkey % 5 + 1 AS INTEGER)] END AS status FROM customer)")
def turnover_notes(spark, d):
    k = F.col("c_custkey")
    rows = T.table(spark, d, "customer").select(F.lpad(k.cast("string"), 8, "0").alias("ico"), F.get(F.array(*map(F.lit, STATUS)), (k % 5).cast("int")).alias("status"), (k * 1000).alias("value_czk"))
    return dossier.turnover(rows)


NOW = "SELECT event_id AS claim_id, ico, 'now:' || kind AS kind, name || ' ' || kind AS value, event_id % 2 AS run_id FROM movement"


def now_claims(spark, d):
    return T.movement(spark, d).select(F.col("event_id").alias("claim_id"), "ico", F.concat(F.lit("now:"), "kind").alias("kind"), F.concat_ws(" ", "name", "kind").alias("value"), F.lit(None).cast("string").alias("quote"), F.lit("fact").alias("state"), (F.col("event_id") % 2).alias("run_id"), F.lit(None).cast("string").alias("relevance"))


@query("q108_distinct_events", with_sql("SELECT min(claim_id) AS claim_id FROM (SELECT *, max(run_id) OVER (PARTITION BY ico) AS newest FROM happened) WHERE run_id = newest GROUP BY ico, kind, lower(value)", "movement", happened=NOW))
def distinct_events(spark, d):
    return dossier.distinct_events(now_claims(spark, d)).select("claim_id")


DOSSIERS = f"""SELECT c.ico, coalesce(e.n, 0) AS n_events, coalesce(u.f, 0) AS n_facts, coalesce(u.i, 0) AS n_inferences, coalesce(x.n, 0) AS n_discounted FROM (SELECT DISTINCT ico FROM claim UNION SELECT ico FROM company) c
    LEFT JOIN (SELECT ico, count(*) AS n FROM (SELECT DISTINCT ico, kind, lower(value) FROM (SELECT *, max(run_id) OVER (PARTITION BY ico) AS newest FROM happened) WHERE run_id = newest) GROUP BY ico) e ON e.ico = c.ico
    LEFT JOIN (SELECT ico, count(*) FILTER (state = 'fact') AS f, count(*) FILTER (state <> 'fact') AS i FROM usable GROUP BY ico) u ON u.ico = c.ico
    LEFT JOIN (SELECT ico, count(*) AS n FROM scored WHERE NOT ({C.ADMISSIBLE}) GROUP BY ico) x ON x.ico = c.ico"""
HAPPENED = "SELECT ico, 'now:' || kind AS kind, name || ' ' || kind AS value, event_id % 2 AS run_id FROM movement UNION ALL SELECT ico, kind, value, run_id FROM claim WHERE kind LIKE 'now:%'"


def documents(spark, d):
    claims = T.claim(spark, d).unionByName(now_claims(spark, d))
    named = T.company(spark, d).select("ico", "name").unionByName(T.claim(spark, d).select("ico").distinct().withColumn("name", F.lit("?")))
    return dossier.dossiers(named, claims)


@query("q109_dossiers", with_sql("SELECT * FROM dossiers", "company", "claim", "movement", happened=HAPPENED, scored=C.NOTNOW, **{"pass": C.PASS.replace("FROM claim", "FROM scored")}, usable=C.USABLE, dossiers=DOSSIERS))
def dossiers(spark, d):
    size = lambda c: F.size(c).cast("long").alias("n_" + c)
    return documents(spark, d).select("ico", *[size(c) for c in ("events", "facts", "inferences", "discounted")])


@query("q110_week_catalogue", with_sql(f"SELECT 'machines' AS wanted, list(ico ORDER BY place) AS companies FROM ({C._quota('leaders', 5)})", *C.SELECT_TABLES, **C.SELECTED, grouped=C.GROUPED, fresh=C.FRESH.format("site_status = 'proven' AND has_channel AND"), leaders=C.LEADERS))
def week_catalogue(spark, d):
    made = dossier.catalogue(C.week(spark, d), documents(spark, d), {"wanted": "machines"})
    read = F.from_json("document", "brief map<string,string>, n long, companies array<struct<place:int,ico:string,events:int>>")
    return made.select(read.alias("r")).select(F.col("r.brief")["wanted"].alias("wanted"), F.transform("r.companies", lambda x: x["ico"]).alias("companies"))


@query("q111_reading_order", with_sql("SELECT w.ico, CAST(row_number() OVER (ORDER BY coalesce(signal_facts, 0) DESC, w.place) AS INTEGER) AS reading FROM ranked w LEFT JOIN rich r ON r.ico = w.ico", *C.SELECT_TABLES, **C.SELECTED))
def reading_order(spark, d):
    return dossier.reading_order(C.ranked(spark, d), C.richness(spark, d)).select("ico", "reading")


@query("q112_baseline", with_sql("SELECT ico, coalesce(nullif(newer, ''), nullif(nace, ''), '') AS code FROM (SELECT *, CASE WHEN CAST(ico AS BIGINT) % 3 = 0 THEN '' ELSE 'N' || nace END AS newer FROM company) WHERE ended IS NULL AND form IN ('112', '121')", "company"))
def baseline(spark, d):
    firms = T.company(spark, d).withColumn("newer", F.when(F.col("ico").cast("long") % 3 == 0, "").otherwise(F.concat(F.lit("N"), "nace")))
    return qualify.baseline(firms, ("112", "121"), ("newer", "nace")).select("ico", "code")


@query("q113_labels", with_sql("SELECT ico, CASE form WHEN '112' THEN 's.r.o.' WHEN '121' THEN 'a.s.' ELSE form END AS form_name FROM company", "company"))
def labels(spark, d):
    return qualify.with_label(T.company(spark, d), "form", {"112": "s.r.o.", "121": "a.s."}, "form_name").select("ico", "form_name")


@query("q114_proven_domains", with_sql("SELECT DISTINCT ico, domain FROM website WHERE status = 'proven' AND coalesce(domain, '') <> ''", "website"))
def proven_domains(spark, d):
    return identity.proven_domains(T.website(spark, d))


@query("q115_admit_newcomers", with_sql("SELECT ico FROM company UNION ALL SELECT p.ico FROM plan p JOIN other o ON p.ico = o.ico WHERE plan = 'new'", "company", "change", latest=C.LATEST, plan=C.PLAN, other=C.OTHER))
def admit_newcomers(spark, d):
    from leadloom.operators import facets

    k = F.col("c_custkey")
    base = T.company(spark, d).select("ico", "band")
    register = T.table(spark, d, "customer").select(F.lpad((k * 2).cast("string"), 8, "0").alias("ico"), F.when(k % 3 == 0, "").otherwise("120").alias("band"))
    return qualify.admit(base, register, facets.change_plan(T.change(spark, d), T.company(spark, d)).where("plan = 'new'")).select("ico")
