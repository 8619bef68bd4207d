"""Queries of domain guesses, contact links, costs, delivered runs, shares of events, and of answers joined to what is known, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import events, evidence, facets, identity, pages, qualify, select, study
from leadloom.plans import catalogue as C
from leadloom.plans import fixtures as T
from leadloom.plans.catalogue import query
from leadloom.plans.fixtures import AS_OF, with_sql
from leadloom.sources import tables

#: How companies are named after their nation and segment: forms at the end and inside, shared words, nothing but a form, long ones.
NAMED = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN n_name || ' Czech Republic, s.r.o.' WHEN 1 THEN replace(c_name, '#', ' č. ') || ', akciová společnost' WHEN 2 THEN 'SE spol AG' WHEN 3 THEN 'ČSAD, s.r.o. ' || c_mktsegment || ' n. ' || n_name
    WHEN 4 THEN n_name || ' - stavební a obchodní společnost' WHEN 5 THEN 'Group CZ' WHEN 6 THEN 's. r. o.' WHEN 7 THEN repeat(n_name || ' ', 9) ELSE c_mktsegment || ' & ' || n_name || ' Int. a.s.' END AS name
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
STEMS = f"""SELECT id, list_filter([list_aggregate(words, 'string_agg', ''), list_aggregate(words, 'string_agg', '-'), list_aggregate(own, 'string_agg', ''), list_aggregate(own, 'string_agg', '-'),
      CASE WHEN len(own) > 2 THEN own[1] || own[2] END, CASE WHEN len(own) > 2 THEN own[1] || '-' || own[2] END, CASE WHEN len(own) > 1 THEN own[1] END, CASE WHEN len(own) > 2 THEN list_aggregate([x[1] for x in own], 'string_agg', '') END], lambda x: x IS NOT NULL AND length(x) BETWEEN 2 AND 63) AS every
    FROM (SELECT id, words, CASE WHEN len([w for w in words if w NOT IN {_LIST(identity.FILLER)}]) > 0 THEN [w for w in words if w NOT IN {_LIST(identity.FILLER)}] ELSE words END AS own
    FROM (SELECT id, CASE WHEN len([w for w in w0 if w NOT IN {_LIST(identity.FORM_WORDS)}]) > 0 THEN [w for w in w0 if w NOT IN {_LIST(identity.FORM_WORDS)}] ELSE w0 END AS words
    FROM (SELECT id, [w for w in string_split(regexp_replace(lower(strip_accents(regexp_replace(name, '{identity.FORM_END}', '', 'i'))), '[^a-z0-9]+', ' ', 'g'), ' ') if w <> ''] AS w0 FROM named)))"""
# The first place of each stem orders the distinct ones.
DISTINCT = "SELECT id, [every[i] for i in range(1, len(every) + 1) if list_position(every, every[i]) = i] AS stems FROM stem"


def named(spark, d):
    k, nation, segment = F.col("c_custkey"), F.col("n_name"), F.col("c_mktsegment")
    forms = (
        F.concat(nation, F.lit(" Czech Republic, s.r.o.")), F.concat(F.replace("c_name", F.lit("#"), F.lit(" č. ")), F.lit(", akciová společnost")), F.lit("SE spol AG"), F.concat(F.lit("ČSAD, s.r.o. "), segment, F.lit(" n. "), nation),
        F.concat(nation, F.lit(" - stavební a obchodní společnost")), F.lit("Group CZ"), F.lit("s. r. o."), F.repeat(F.concat(nation, F.lit(" ")), 9),
    )
    name = F.concat(segment, F.lit(" & "), nation, F.lit(" Int. a.s."))
    for i, form in enumerate(forms):
        name = F.when(k % 9 == i, form).otherwise(name)
    return T.table(spark, d, "customer").join(T.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), name.alias("name"))


@query("q144_company_domains", f"WITH named AS ({NAMED}), stem AS ({STEMS}), once AS ({DISTINCT}) SELECT id, array_to_string(list_slice(list_concat(['seed.cz'], [s || '.cz' for s in stems if s <> 'seed'], flatten([[s || '.com', s || '.eu'] for s in stems[1:3]])), 1, 24), ' ') AS domains FROM once")
def company_domains(spark, d):
    made = identity.domain_candidates(F.array(F.lit(" WWW.seed.cz"), F.lit(".seed.cz"), F.lit("nodot")), F.col("name"))
    return named(spark, d).select("id", F.array_join(made, " ").alias("domains"))


#: Links of pages: address after the site's own, label; by rank: names as a whole, with a language, words, labels, hints only, others.
LINKS = (
    ("/kontakt", "x"), ("/cs/kontakt", "again"), ("/firma/contact-us.html", "x"), ("/a/b", "Kontakt"), ("/o-nas", "x"), ("/footer/mapa", "x"), ("/news", "x"), ("https://other.example/kontakt", "x"), ("mailto:kontakt@firma.cz", "x"), ("/EN/Impressum", "x"),
)
_LINKED = "SELECT page_id, [l for l in list_value(" + ", ".join(f"{{'i': {i}, 'url': '{h}', 'rank': {r}, 'n': {n}}}" for i, (h, r, n) in enumerate((("/kontakt", 3, 8), ("/EN/Impressum", 3, 13), ("/a/b", 2, 4), ("/firma/contact-us.html", 2, 22), ("/o-nas", 1, 6), ("/footer/mapa", 1, 12)))) + ") if (page_id + l.n) % 4 <> 0] AS links FROM pages"


@query("q148_contact_links", f"SELECT page_id, i.url AS path, i.rank AS rank, CAST(place AS INTEGER) AS place FROM (SELECT page_id, unnest(links) AS i, generate_subscripts(links, 1) AS place FROM ({_LINKED})) WHERE place <= 5")
def contact_links(spark, d):
    """Links planted on each page in an order by page; some are missing on every page."""
    rows = T.table(spark, d, "pages").where("url is not null")
    links = F.array(*[F.struct(F.lit(h).alias("href"), F.lit(a).alias("label")) for h, a in LINKS])
    # A path in another language stands behind the plain one and is missing with it.
    there = F.filter(links, lambda x: (F.col("page_id") + F.length(F.when(x["href"] == "/cs/kontakt", "/kontakt").otherwise(x["href"]))) % 4 != 0)
    found = rows.select("page_id", F.lit("https://www.firma.example/start").alias("base"), F.posexplode(there).alias("pos", "l")).select("page_id", "base", "pos", "l.href", "l.label")
    got = pages.contact_links(found, hint=pages.CONTACT_HINT)
    return got.select("page_id", F.regexp_replace("url", "^https://www.firma.example", "").alias("path"), "rank", "place")


#: model, mode, input, output, cached input (fixed prices per million tokens).
RATES = (("user", "sync", 2.5, 10.0, 1.25), ("user", "batch", 1.25, 5.0, None), ("assistant", "sync", 0.5, 1.5, 0.05))
COSTS = """SELECT c.*, round((tokens_in * coalesce(CASE WHEN cached THEN pc END, pi) + tokens_out * po) / 1000000, 6) AS cost FROM (SELECT conv_id, turn, role AS model, CASE WHEN conv_id % 3 = 0 THEN 'batch' ELSE 'sync' END AS mode, turn % 2 = 1 AS cached, coalesce(length(text), 0) AS tokens_in, turn AS tokens_out FROM conversations) c
    LEFT JOIN (VALUES """ + ", ".join(f"('{m}', '{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({'NULL' if x is None else x} AS DOUBLE))" for m, k, a, b, x in RATES) + ") p(m, k, pi, po, pc) ON model = m AND mode = k"  # fmt: skip


@query("q149_call_costs", with_sql("SELECT model, mode, count(*) AS calls, count(*) FILTER (cost IS NULL) AS unpriced, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(coalesce(sum(CAST(cost AS DECIMAL(18, 6))), 0) AS DECIMAL(18, 3)) AS cost FROM costs GROUP BY model, mode", costs=COSTS))
def call_costs(spark, d):
    calls = T.table(spark, d, "conversations").select(
        "conv_id", F.col("role").alias("model"), F.when(F.col("conv_id") % 3 == 0, "batch").otherwise("sync").alias("mode"), (F.col("turn") % 2 == 1).alias("cached"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens_in"), F.col("turn").cast("long").alias("tokens_out"),
    )
    prices = spark.createDataFrame(list(RATES), "model string, mode string, price_in double, price_out double, price_cached double")
    costs = facets.call_costs(calls, prices).withColumn("cost", F.col("cost").cast("decimal(18,6)"))
    return facets.spent(costs, ["model", "mode"]).withColumn("cost", F.col("cost").cast("decimal(18,3)"))


# Two hundred runs, each a list; every ninth company is unknown.
RUNS = "SELECT ico, run_id % 200 AS run_id, delivered_on FROM delivered"


@query("q145_delivered_runs", with_sql("SELECT run_id, max(delivered_on) AS delivered_on, count(*) AS n, md5(string_agg(ico || ':' || coalesce(name, '?') || ':' || delivered_on || ':' || times, ',' ORDER BY ico, name NULLS FIRST, delivered_on)) AS companies FROM (SELECT r.*, count(*) OVER (PARTITION BY r.ico) AS times, c.name FROM runs r LEFT JOIN (SELECT * FROM company WHERE CAST(ico AS BIGINT) % 9 <> 0) c ON r.ico = c.ico) GROUP BY run_id", "company", "delivered", runs=RUNS))
def delivered_runs(spark, d):
    runs = T.delivered(spark, d).withColumn("run_id", F.col("run_id") % 200)
    known = T.company(spark, d).where(F.col("ico").cast("long") % 9 != 0)
    line = F.transform("companies", lambda x: F.concat_ws(":", x["ico"], F.coalesce(x["name"], F.lit("?")), x["delivered_on"].cast("string"), x["times"].cast("string")))
    return select.delivered_runs(runs, known).select("run_id", "delivered_on", "n", F.md5(F.array_join(line, ",").cast("binary")).alias("companies"))


@query("q146_delivery_totals", with_sql("SELECT count(DISTINCT run_id) AS runs, count(*) AS deliveries, count(DISTINCT ico) AS companies FROM runs", "delivered", runs=RUNS))
def delivery_totals(spark, d):
    return select.delivery_totals(T.delivered(spark, d).withColumn("run_id", F.col("run_id") % 200))


@query("q147_owner_shares", with_sql("SELECT count(*) AS owner_events, count(*) FILTER (legal_entity) AS legal_entities, count(*) FILTER (legal_entity) / count(*) AS share FROM movement WHERE kind LIKE 'owner\\_%' ESCAPE '\\'", "movement"))
def owner_shares(spark, d):
    return study.owner_shares(T.movement(spark, d))


RECORD = f"""SELECT ico, 'owner' AS role, 'p' || CAST(event_id % 4 AS VARCHAR) AS name, false AS departed FROM movement WHERE event_id % 5 = 0 UNION ALL
    SELECT ico, 'director', name, event_id % 2 = 0 FROM movement WHERE event_id % 5 = 1"""


@query("q150_familiar_arrivals", with_sql("SELECT count(*) AS arrivals, count(*) FILTER (known) AS familiar, count(*) FILTER (known) / count(*) AS share FROM (SELECT (ico, lower(name)) IN (SELECT (ico, lower(name)) FROM record WHERE role = 'owner' OR departed) AS known FROM movement WHERE kind = 'director_joined')", "movement", record=RECORD))
def familiar_arrivals(spark, d):
    moves = T.movement(spark, d)
    i = F.col("event_id")
    owners = moves.where(i % 5 == 0).select("ico", F.lit("owner").alias("role"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("name"), F.lit(False).alias("departed"))
    directors = moves.where(i % 5 == 1).select("ico", F.lit("director").alias("role"), "name", (i % 2 == 0).alias("departed"))
    return study.familiar_arrivals(moves, owners.unionByName(directors))


@query("q151_events_by_age", with_sql(f"SELECT ico, date, kind, name, CAST({C.AGE.format('date')} AS INTEGER) AS age_days, CAST(row_number() OVER (PARTITION BY ico ORDER BY {C.AGE.format('date')}, kind, name) AS INTEGER) AS place FROM movement", "movement"))
def events_by_age(spark, d):
    return events.by_age(T.movement(spark, d).select("ico", "date", "kind", "name"), AS_OF)


@query("q152_summary", with_sql("SELECT ico, name, band AS size, nace, form, district, region AS city FROM company", "company"))
def summary(spark, d):
    return qualify.summary(T.company(spark, d).withColumn("city", F.col("region")))


@query("q153_to_mark", with_sql("SELECT DISTINCT ico, run_id FROM (SELECT ico, run_id % 200 AS run_id FROM delivered UNION ALL SELECT ico, run_id % 300 FROM delivered) f WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.ico = f.ico AND r.run_id = f.run_id)", "delivered", runs=RUNS))
def to_mark(spark, d):
    rows = T.delivered(spark, d)
    own = rows.withColumn("run_id", F.col("run_id") % 200)
    fresh = own.unionByName(rows.withColumn("run_id", F.col("run_id") % 300)).select("ico", "run_id")
    return select.mark_delivered(own, fresh)


@query("q154_judged_claims", with_sql("SELECT claim_id, CASE claim_id % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'unrelated' ELSE relevance END AS relevance FROM claim", "claim"))
def judged_claims(spark, d):
    rows = T.claim(spark, d)
    word = F.when(F.col("claim_id") % 4 == 0, "supports").when(F.col("claim_id") % 4 == 1, "unrelated").when(F.col("claim_id") % 4 == 2, "perhaps")
    verdicts = rows.select("claim_id", word.alias("verdict"))
    return evidence.apply_verdicts(rows, verdicts).select("claim_id", "relevance")


FILLED = "SELECT c_custkey AS id, nullif(CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '' END, '') AS city, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_nationkey IS NOT NULL THEN n_name END AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"


@query("q155_filled_fields", FILLED)
def filled_fields(spark, d):
    """Register rows with blanks, filled from another register."""
    k = F.col("c_custkey")
    rows = T.table(spark, d, "customer").join(T.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    base = rows.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).otherwise("  ").alias("city"), F.when(k % 2 == 0, F.col("c_name")).alias("name"))
    other = rows.select(k.alias("id"), F.when(k % 5 != 0, F.col("c_mktsegment")).otherwise("").alias("city"), F.col("n_name").alias("name"))
    return tables.coalesce_fields(base, other, "id", ["city", "name"])


@query("q156_listed_on_page", with_sql("""SELECT ico, name, email, phone, 'register' AS source FROM board LEFT JOIN print USING (ico, key) UNION ALL
    SELECT ico, page_name, email, phone, 'page' FROM print p WHERE tier <> 'page_weak' AND NOT EXISTS (SELECT 1 FROM board b WHERE b.ico = p.ico AND b.key = p.key)""",
    board="SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ico, 'Jan Dvořák' AS name, 'jan dvorak' AS key FROM customer UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 'Eva Malá', 'eva mala' FROM customer WHERE c_custkey % 2 = 0",
    print="SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ico, key, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey || '@firma.cz' END AS email, c_mktsegment AS phone, page_name, CASE WHEN c_custkey % 5 = 0 THEN 'page_weak' ELSE 'page' END AS tier FROM customer, (VALUES ('jan dvorak', 'JAN DVOŘÁK'), ('eva mala', 'Eva MALÁ')) v(key, page_name)"))
def listed_on_page(spark, d):
    rows = T.table(spark, d, "customer")
    k = F.col("c_custkey")
    ico = F.lpad(k.cast("string"), 8, "0").alias("ico")
    board = rows.select(ico, F.lit("Jan Dvořák").alias("name")).unionByName(rows.where(k % 2 == 0).select(ico, F.lit("Eva Malá").alias("name")))
    seen = rows.select(
        ico, F.explode(F.array(F.lit("JAN DVOŘÁK"), F.lit("Eva MALÁ"))).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"), F.lit("@firma.cz"))).alias("email"),
        F.col("c_mktsegment").alias("phone"), F.when(k % 5 == 0, "page_weak").otherwise("page").alias("tier"),
    )
    return identity.listed_on_page(board, seen)


@query("q157_registrants", "SELECT 'd' || s_suppkey || '.cz' AS domain, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Org ' || s_nationkey END AS org, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' 1' ELSE s_name || ' 1' || ', Brno' END AS address, '01.02.2003' AS created FROM supplier")
def registrants(spark, d):
    """Answers of a domain register: the domain's own lines, the holder's contact, another contact behind it."""
    s = F.col("s_suppkey")
    holder = F.concat_ws("\n", F.lit("contact:      ID"), F.when(s % 2 == 0, F.concat(F.lit("org:          Org "), F.col("s_nationkey").cast("string"))), F.concat(F.lit("name:         "), "s_name"), F.concat(F.lit("address:      "), "s_name", F.lit(" 1")), F.when(s % 3 != 0, "address:      Brno"), F.lit("created:      01.02.2003"))
    text = F.concat(F.lit("domain:       d.cz\nname:         not this\nregistered:   01.01.2001\n\n"), holder, F.lit("\n\ncontact:      TECH\nname:         not this either\naddress:      Praha\ncreated:      05.05.2005\n"))
    return identity.registrant_block(T.table(spark, d, "supplier").select(F.concat(F.lit("d"), s.cast("string"), F.lit(".cz")).alias("domain"), text.alias("text")))
