"""Queries of the identity operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators import facets, identity, pages, qualify
from leadloom.plans import fixtures as T
from leadloom.plans.catalogue import query
from leadloom.plans.fixtures import with_sql
from leadloom.sources import tables

PEOPLE = "SELECT ico, 'Ing. Jan ' || CASE event_id % 3 WHEN 0 THEN 'Dvořák' WHEN 1 THEN 'Novák' ELSE 'Malý' END AS name, event_id // 30 % 2 AS born FROM movement"


def people(spark, d):
    """Board members: names by event, birth marks that collide."""
    i = F.col("event_id")
    last = F.when(i % 3 == 0, "Dvořák").when(i % 3 == 1, "Novák").otherwise("Malý")
    return T.movement(spark, d).select("ico", F.concat(F.lit("Ing. Jan "), last).alias("name"), F.expr("event_id div 30 % 2").alias("born"))


@query("q67_namesakes", with_sql("SELECT ico, name FROM people GROUP BY ico, name HAVING count(DISTINCT born) > 1", "movement", people=PEOPLE))
def namesakes(spark, d):
    return identity.namesakes(people(spark, d))


@query("q68_person_parts", with_sql("SELECT given, surname, count(*) AS n FROM (SELECT 'jan' AS given, CASE split_part(name, ' ', 3) WHEN 'Dvořák' THEN 'dvorak' WHEN 'Novák' THEN 'novak' ELSE 'maly' END AS surname FROM people) GROUP BY given, surname", "movement", people=PEOPLE))
def person_parts(spark, d):
    split = people(spark, d).select(identity.split_person(F.col("name")).alias("p"))
    return split.groupBy("p.given", "p.surname").agg(F.count("*").alias("n"))


@query("q69_domain_candidates", "SELECT c_custkey AS id, ['seed.cz', 'customer' || k || '.cz', 'customer-' || k || '.cz', 'customer.cz', 'customer' || k || '.com', 'customer' || k || '.eu', 'customer-' || k || '.com', 'customer-' || k || '.eu', 'customer.com', 'customer.eu'] AS domains FROM (SELECT c_custkey, split_part(c_name, '#', 2) AS k FROM customer)")
def domain_candidates(spark, d):
    made = identity.domain_candidates(F.array(F.lit("seed.cz")), F.col("c_name"))
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), made.alias("domains"))


@query("q70_seed_domains", "SELECT ico, domain, min(page_id) AS pos FROM (SELECT lpad(CAST(page_id % 40 AS VARCHAR), 8, '0') AS ico, page_id, domain FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM pages)) WHERE domain NOT IN (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') FROM pages WHERE page_id % 17 = 0) GROUP BY ico, domain")
def seed_domains(spark, d):
    hosts = T.table(spark, d, "pages").withColumn("domain", pages.host(F.col("url")))
    rows = hosts.select(F.lpad((F.col("page_id") % 40).cast("string"), 8, "0").alias("ico"), "domain", F.col("page_id").alias("pos"))
    return identity.seed_domains(rows, hosts.where("page_id % 17 = 0").select("domain"))


CONTACT = "SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, 'Jan ' || CASE o_orderkey % 4 WHEN 0 THEN 'Dvořák' WHEN 1 THEN 'Novák' WHEN 2 THEN 'Malý' ELSE 'Nikdo' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'a@firma.cz' ELSE 'b@jinde.cz' END AS email FROM orders"
GRADED = "SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM people p WHERE p.ico = c.ico AND split_part(p.name, ' ', 3) = split_part(c.name, ' ', 2)) THEN 'register' WHEN email LIKE '%@firma.cz' THEN 'own_domain' ELSE 'external' END AS tier FROM contact c"


@query("q71_tender_contacts", with_sql("SELECT ico, name, email, CAST(min(CASE tier WHEN 'register' THEN 0 WHEN 'own_domain' THEN 1 ELSE 2 END) AS INTEGER) AS rank, arg_min(tier, CASE tier WHEN 'register' THEN 0 WHEN 'own_domain' THEN 1 ELSE 2 END) AS tier FROM graded GROUP BY ico, name, email", "movement", people=PEOPLE, contact=CONTACT, graded=GRADED))
def tender_contacts(spark, d):
    k = F.col("o_orderkey")
    last = F.when(k % 4 == 0, "Dvořák").when(k % 4 == 1, "Novák").when(k % 4 == 2, "Malý").otherwise("Nikdo")
    rows = T.table(spark, d, "orders")
    rows = rows.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), F.concat(F.lit("Jan "), last).alias("name"), F.when(k % 5 == 0, "a@firma.cz").otherwise("b@jinde.cz").alias("email"))
    domains = T.company(spark, d).select("ico", F.lit("firma.cz").alias("domain"))
    return identity.tender_contacts(identity.contact_tier(rows, people(spark, d), domains))


ANSWER = "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS ico, s_suppkey % 3 AS pos, 'd' || s_suppkey || '.cz' AS domain, CASE s_suppkey % 4 WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 1 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' Holding' WHEN 2 THEN 'nobody' ELSE 'else' END AS registrant, s_suppkey % 2 AS postcode, s_suppkey FROM supplier"


@query("q72_registrant_tier", with_sql("SELECT a.ico, domain, CASE s_suppkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'partial' ELSE 'postcode' END AS tier FROM answer a JOIN company c ON a.ico = c.ico AND c.name NOT LIKE '%likvidaci' WHERE s_suppkey % 4 IN (0, 1) OR postcode = 0", "company", answer=ANSWER))
def registrant_tier(spark, d):
    s = F.col("s_suppkey")
    name = F.concat(F.lit("Customer#"), F.lpad(s.cast("string"), 9, "0"))
    answers = T.table(spark, d, "supplier").select(
        F.lpad(s.cast("string"), 8, "0").alias("ico"), (s % 3).alias("pos"), F.concat(F.lit("d"), s.cast("string"), F.lit(".cz")).alias("domain"),
        F.when(s % 4 == 0, name).when(s % 4 == 1, F.concat(name, F.lit(" Holding"))).when(s % 4 == 2, "nobody").otherwise("else").alias("registrant"), (s % 2).alias("postcode"),
    )
    firms = T.company(spark, d).where("name not like '%likvidaci'").withColumn("postcode", F.lit(0).cast("long"))
    return identity.registrant_tier(answers, firms, people(spark, d))


@query("q73_best_domain", with_sql("SELECT ico, arg_min(domain, CAST(r AS BIGINT) * 1000000000 + pos) AS domain, arg_min(evidence, CAST(r AS BIGINT) * 1000000000 + pos) AS evidence FROM (SELECT lpad(CAST(CAST(ico AS INTEGER) % 30 AS VARCHAR), 8, '0') AS ico, CAST(ico AS INTEGER) AS pos, domain, evidence, CASE evidence WHEN 'ico' THEN 0 WHEN 'person' THEN 1 WHEN 'address' THEN 2 WHEN 'name_city' THEN 3 END AS r FROM website) WHERE r IS NOT NULL GROUP BY ico", "website"))
def best_domain(spark, d):
    n = F.col("ico").cast("int")
    rows = T.website(spark, d).select(F.lpad((n % 30).cast("string"), 8, "0").alias("ico"), n.alias("pos"), "domain", "evidence")
    return identity.best_domain(rows, {"ico": 0, "person": 1, "address": 2, "name_city": 3})


@query("q74_regrade", with_sql("SELECT w.ico, CASE WHEN c.ico IS NOT NULL AND status <> 'proven' THEN 'proven' ELSE status END AS status, c.ico IS NOT NULL AND status <> 'proven' AS regraded FROM website w LEFT JOIN (SELECT ico FROM company WHERE site_status = 'proven') c ON w.ico = c.ico", "website", "company"))
def regrade(spark, d):
    proofs = T.company(spark, d).where("site_status = 'proven'").select("ico", F.lit("ico").alias("evidence"))
    return identity.regrade(T.website(spark, d), proofs).select("ico", "status", "regraded")


@query("q75_snapshot_for", with_sql("SELECT f.id, CASE WHEN f.url IS NOT NULL THEN l.id ELSE s.id END AS snapshot_id FROM snapshot f LEFT JOIN latest l ON f.ico = l.ico AND f.source = l.source AND f.url = l.url LEFT JOIN (SELECT ico, source, max(id) AS id FROM latest GROUP BY ico, source) s ON s.ico = f.ico AND s.source = f.source", "snapshot",
    latest="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ico, url ORDER BY fetched_at DESC, id DESC) AS n FROM snapshot) WHERE n = 1"))
def snapshot_for(spark, d):
    from leadloom.operators import evidence

    rows = T.snapshot(spark, d)
    happened = rows.select("ico", "source", "url", F.col("id").alias("event"))
    found = identity.snapshot_for(happened, evidence.latest_documents(rows))
    return found.select(F.col("event").alias("id"), "snapshot_id")


@query("q76_current_departed", with_sql("SELECT ico, count(*) FILTER (kind LIKE '%joined') AS n_current, count(*) FILTER (kind LIKE '%departed') AS n_departed FROM movement GROUP BY ico", "movement"))
def current_departed(spark, d):
    entry = F.struct("name", F.when(F.endswith("kind", F.lit("departed")), F.col("date")).alias("until"))
    lists = T.movement(spark, d).groupBy("ico").agg(F.collect_list(entry).alias("entries"))
    split = lists.select("ico", identity.split_by_end(F.col("entries")).alias("s"))
    return split.select("ico", F.size("s.current").cast("long").alias("n_current"), F.size("s.departed").cast("long").alias("n_departed"))


@query("q77_statement_totals", "SELECT ico, year, CAST(sum(q) FILTER (r IN (1, 2)) * 1000 AS BIGINT) AS value_czk, CAST(sum(p) FILTER (r IN (1, 2)) * 1000 AS BIGINT) AS previous_czk FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ico, year(o_orderdate) AS year, l_linenumber AS r, CAST(l_quantity AS BIGINT) AS q, CAST(l_suppkey AS BIGINT) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ico, year")
def statement_totals(spark, d):
    rows = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return tables.statement_totals(rows.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), F.year("o_orderdate").alias("year"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("long").alias("current"), F.col("l_suppkey").cast("long").alias("previous")))


@query("q78_selection_state", with_sql("SELECT division, CAST(coalesce(sum(n) FILTER (on_), 0) AS BIGINT) AS companies, CASE WHEN count(*) FILTER (on_) = count(*) THEN 'on' WHEN count(*) FILTER (on_) > 0 THEN 'some' ELSE 'off' END AS state FROM (SELECT substr(nace, 1, 2) AS division, nace, count(*) AS n, max(CAST(nace AS INTEGER)) % 3 <> 0 AS on_ FROM company WHERE nace <> '' GROUP BY nace) GROUP BY division", "company"))
def selection_state(spark, d):
    codes = facets.code_rollup(T.company(spark, d)).where("code is not null")
    return facets.selection_state(codes, codes.where("cast(code as int) % 3 <> 0"))


@query("q79_code_names", with_sql("SELECT c.ico, coalesce(CASE WHEN length(nace) = 5 AND CAST(nace AS INTEGER) % 4 = 0 THEN 'level 5 ' || nace END, CASE WHEN nace <> '' THEN 'division ' || substr(nace, 1, 2) END) AS code_name FROM company c", "company"))
def code_names(spark, d):
    firms = T.company(spark, d)
    full = firms.where("length(nace) = 5 and cast(nace as int) % 4 = 0").select(F.col("nace").alias("code"), F.concat(F.lit("level 5 "), "nace").alias("text"))
    parts = firms.where("nace <> ''").select(F.substring("nace", 1, 2).alias("code"), F.concat(F.lit("division "), F.substring("nace", 1, 2)).alias("text"))
    return qualify.code_names(firms, full.unionByName(parts).distinct(), "nace").select("ico", "code_name")


@query("q80_request_cache", "SELECT count(*) AS to_ask FROM (SELECT DISTINCT sha256(role || '|' || text) AS k FROM conversations WHERE conv_id % 2 = 1) WHERE k NOT IN (SELECT sha256(role || '|' || text) FROM conversations WHERE conv_id % 2 = 0)")
def request_cache(spark, d):
    rows = T.table(spark, d, "conversations").withColumn("cache_key", X.request_key("role", "text"))
    return tables.resume(rows.where("conv_id % 2 = 1").select("cache_key").distinct(), rows.where("conv_id % 2 = 0"), "cache_key").agg(F.count("*").alias("to_ask"))


@query("q81_feed_archive", with_sql("SELECT ico, count(*) AS n, count(DISTINCT date) AS days FROM vacancy GROUP BY ico", "vacancy"))
def feed_archive(spark, d):
    rows = T.vacancies(spark, d)[1].select("ico", "date", "title")
    documents = tables.archive_documents(rows, "ico", ["date", "title"])
    parsed = documents.select("ico", F.from_json("document", "array<struct<date:date,title:string>>").alias("rows"))
    return parsed.select("ico", F.size("rows").cast("long").alias("n"), F.size(F.array_distinct(F.transform("rows", lambda r: r["date"]))).cast("long").alias("days"))


@query("q82_places", "SELECT p_partkey AS code, coalesce(s_name, p_name) AS name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 2 UNION ALL SELECT s_suppkey * 2, s_name FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT p_partkey FROM part)")
def places(spark, d):
    towns = T.table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    parts = T.table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("code"), F.col("s_name").alias("name"))
    return identity.places_with_parts(towns, parts)


@query("q83_unit_scale", "SELECT doc_id AS id, CAST(CASE doc_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS INTEGER) AS scale FROM documents")
def unit_scale(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, "mil. k ... v tis. Kč\n").when(i % 3 == 1, "v tis.\nmil. kč\n").otherwise("")
    return identity.unit_scale(T.table(spark, d, "documents").select(i.alias("id"), F.concat(head, F.lit("Tržby 1 200\nv tis."), F.coalesce("text", F.lit(""))).alias("text")), "Tržby")


@query("q84_revenue_windows", "SELECT doc_id AS id, 'trzby' AS label, 1200 + doc_id % 10 AS number FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'obrat', 77 FROM documents WHERE doc_id % 3 = 0")
def revenue_windows(spark, d):
    i = F.col("doc_id")
    head = F.concat(F.when(i % 2 == 0, F.concat(F.lit("Tržby: 1 "), (200 + i % 10).cast("string"), F.lit(" tis\n"))).otherwise(""), F.when(i % 3 == 0, "OBRAT 77\n").otherwise(""))
    docs = T.table(spark, d, "documents").select(i.alias("id"), F.concat(head, F.regexp_replace("text", r"\d", "x")).alias("text"))
    return pages.revenue_windows(docs).select("id", "label", F.col("numbers")[0].alias("number"))


@query("q85_person_contacts", with_sql("SELECT ico, count(*) AS people, count(*) FILTER (ev % 2 = 0) AS reached, CAST(sum(CASE WHEN ev % 3 = 0 THEN 0 ELSE 4 END + CASE WHEN ev % 2 = 0 THEN 3 ELSE 0 END + 2) AS BIGINT) AS score FROM (SELECT ico, name, max(event_id) AS ev FROM (SELECT ico, event_id, 'Jan Novák' || chr(CAST(97 + event_id % 20 AS INTEGER)) AS name FROM movement) GROUP BY ico, name) GROUP BY ico", "movement"))
def person_contacts(spark, d):
    i = F.col("event_id")
    rows = T.movement(spark, d).select("ico", i.alias("page_ord"), F.concat(F.lit("Jan Novák"), F.char(97 + i % 20)).alias("name"))
    last = rows.groupBy("ico", "name").agg(F.max("page_ord").alias("page_ord"))
    mail = F.when(F.col("page_ord") % 2 == 0, F.concat(F.lit(" j.novak"), F.substring("name", -1, 1), F.lit("@firma.cz"))).otherwise("")
    # Every third page gives the surname alone, after prose that names the person without any detail.
    shown = F.when(F.col("page_ord") % 3 == 0, F.concat(F.lit("Petr "), F.split("name", " ")[1])).otherwise(F.col("name"))
    text = last.select("ico", "page_ord", F.concat(F.lit("Dnes "), "name", F.lit(" mlčí. " + "a " * 80 + "Ing. "), shown, F.lit(", jednatel"), mail, F.lit(".")).alias("text"))
    found = pages.person_occurrences(text, rows)
    return found.groupBy("ico").agg(F.count("*").alias("people"), F.count("email").alias("reached"), F.sum("score").cast("long").alias("score"))
