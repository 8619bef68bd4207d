"""Queries of the company index, feed studies and people printed on pages, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators import facets, pages, people, study
from leadloom.plans import catalogue as C
from leadloom.plans import fixtures as T
from leadloom.plans.catalogue import query
from leadloom.plans.fixtures import AS_OF, with_sql

ENTRY = """SELECT lpad(CAST(c_custkey // 2 AS VARCHAR), 8, '0') AS ico, CASE WHEN c_custkey % 3 = 0 THEN 'owner' ELSE 'director' END AS role, c_name AS name,
    CASE WHEN c_custkey % 7 <> 0 THEN DATE '2020-01-01' + CAST(c_custkey * 11 % 1400 AS INTEGER) END AS since, CASE WHEN c_custkey % 4 = 0 THEN DATE '2024-01-01' - CAST(c_custkey % 90 AS INTEGER) END AS until FROM customer"""


def entries(spark, d):
    """Register entries, two to a company; some without a first day, every fourth departed."""
    k = F.col("c_custkey")
    return T.table(spark, d, "customer").select(
        F.lpad(F.floor(k / 2).cast("string"), 8, "0").alias("ico"), F.when(k % 3 == 0, "owner").otherwise("director").alias("role"), F.col("c_name").alias("name"),
        F.when(k % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k * 11 % 1400).cast("int"))).alias("since"), F.when(k % 4 == 0, F.date_sub(F.lit("2024-01-01").cast("date"), (k % 90).cast("int"))).alias("until"),
    )


@query("q116_register_dates", with_sql("SELECT ico, since AS date, role || '_joined' AS kind, lower(name) AS name FROM entry WHERE since IS NOT NULL UNION ALL SELECT ico, until, role || '_departed', lower(name) FROM entry WHERE until IS NOT NULL", entry=ENTRY))
def register_dates(spark, d):
    return study.register_dates(entries(spark, d))


_HEADS = "CASE band " + " ".join(f"WHEN '{b}' THEN {n}" for b, n in study.MIDPOINT.items()) + " END"


@query("q117_vacancy_ceiling", with_sql(f"SELECT CAST(w AS INTEGER) AS width, count(*) AS any_vacancy, count(*) FILTER (n >= 3) AS three_plus, count(*) FILTER (n / heads >= 0.1) AS tenth, count(*) FILTER (m > 0) AS management FROM (SELECT w, ico, count(*) AS n, count(*) FILTER (occupation IN {C._in(T.GROUPS)}) AS m FROM vacancy, (SELECT unnest({list(C.WIDTHS)}) AS w) WHERE {C.AGE.format('date')} BETWEEN 0 AND w GROUP BY w, ico) JOIN (SELECT ico, {_HEADS} AS heads FROM company) USING (ico) GROUP BY w", "vacancy", "company"))
def vacancy_ceiling(spark, d):
    rows = T.vacancies(spark, d)[1].withColumn("occupation", X.occupation_group("isco"))
    return study.vacancy_ceiling(rows, T.company(spark, d), T.GROUPS, C.WIDTHS, AS_OF)


@query("q118_base_rate", with_sql(f"SELECT band <> '' AS known, count(*) AS companies, count(h.ico) AS hits, avg(CASE WHEN h.ico IS NULL THEN 0 ELSE 1 END) AS rate FROM company c LEFT JOIN (SELECT DISTINCT ico FROM movement WHERE {C.AGE.format('date')} BETWEEN 0 AND 14) h ON c.ico = h.ico GROUP BY 1", "company", "movement"))
def base_rate(spark, d):
    hits = T.movement(spark, d).where(F.datediff(F.lit(AS_OF).cast("date"), "date").between(0, 14))
    return study.base_rate(T.company(spark, d), hits, F.col("band") != "")


_FEEDS = {"subsidy": T.subsidy, "tender": T.tender, "vacancy": lambda spark, d: T.vacancies(spark, d)[1], "movement": T.movement}


@query("q119_feed_overlap", with_sql(" UNION ALL ".join(f"SELECT '{f}' AS feed, count(*) AS n, count(DISTINCT c.ico) AS companies FROM {f} x LEFT JOIN company c ON x.ico = c.ico" for f in _FEEDS), "company", *_FEEDS))
def feed_overlap(spark, d):
    return study.feed_overlap({f: rows(spark, d) for f, rows in _FEEDS.items()}, T.company(spark, d))


INDEXED = """SELECT lpad(CAST(c_custkey // 2 AS VARCHAR), 8, '0') AS ico, c_custkey AS pos, c_name AS name, lpad(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 5, '0') AS code,
    c_nationkey + CASE WHEN c_custkey % 6 = 0 THEN 100 ELSE 0 END AS place FROM customer"""


@query("q120_company_index", with_sql("SELECT i.ico, i.name, i.code, i.place, substr(code, 1, 2) AS division, 48 + n_nationkey / 10.0 AS lat, 12 + n_regionkey / 2.0 AS lon FROM indexed i JOIN (SELECT ico, max(pos) AS pos FROM indexed GROUP BY ico) USING (ico, pos) LEFT JOIN nation ON n_nationkey = i.place", indexed=INDEXED))
def company_index(spark, d):
    k = F.col("c_custkey")
    place = (F.col("c_nationkey") + F.when(k % 6 == 0, 100).otherwise(0)).alias("place")
    rows = T.table(spark, d, "customer").select(F.lpad(F.floor(k / 2).cast("string"), 8, "0").alias("ico"), k.alias("pos"), F.col("c_name").alias("name"), F.lpad((k * 7919 % 100000).cast("string"), 5, "0").alias("code"), place)
    towns = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), (48 + F.col("n_nationkey") / 10.0).alias("lat"), (12 + F.col("n_regionkey") / 2.0).alias("lon"))
    return facets.company_index(rows, towns).select("ico", "name", "code", "place", "division", "lat", "lon")


@query("q121_division_documents", with_sql("SELECT division, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (nace = division), 0) AS BIGINT) AS bare, coalesce(string_agg(nace || ':' || n, ',' ORDER BY n DESC, nace) FILTER (nace <> division), '') AS codes FROM (SELECT substr(nace, 1, 2) AS division, nace, count(*) AS n FROM company WHERE nace <> '' GROUP BY 1, 2) GROUP BY division", "company"))
def division_documents(spark, d):
    rows = facets.division_documents(T.company(spark, d))
    return rows.withColumn("codes", F.array_join(F.transform("codes", lambda c: F.concat_ws(":", c["code"], c["n"].cast("string"))), ","))


#: Rows of contact tables that stand before the pages' own texts.
ROWS = (
    "Petr Dvořák jednatel dvorak@firma.cz +420 777 123 456 ", "Velká Bystřice vedoucí 777 222 333 ", "Ing. Jana Malá vedoucí výroby Karel Novák 605 111 222 ",
    "Pavel Procházka obchodní 595 223 218 Jan Kos jednatel jan.kos@cizi.cz ", "Eva Tichá ředitelka ticha@seznam.cz Petr Dvořák jednatel 602 333 444 ",
)


def printed(spark, d):
    """Pages, four to a company, with a row of a contact table before the whole page."""
    i = F.col("page_id")
    row = F.get(F.array(*map(F.lit, ROWS)), (i % len(ROWS)).cast("int"))
    return T.table(spark, d, "pages").select(
        F.lpad(F.floor(i / 4).cast("string"), 8, "0").alias("ico"), i.alias("page_ord"), F.concat(row, F.lit(". "), pages.page_text(F.col("html"))).alias("text"),
        F.lit("firma.cz").alias("domain"), F.when(i % 2 == 0, "Kos").alias("city"),
    )


@query("q122_page_people")
def page_people(spark, d):
    known = T.table(spark, d, "customer").select(F.lpad("c_custkey", 8, "0").alias("ico"), F.when(F.col("c_custkey") % 3 == 0, "DVOŘÁK Petr").otherwise(F.col("c_name")).alias("name"))
    return people.page_people(printed(spark, d), known)


@query("q123_street_number", "SELECT lpad(CAST(page_id AS VARCHAR), 8, '0') AS ico, page_id AS page_ord FROM pages WHERE (page_id % 3 <> 0 OR page_id = 9) AND page_id % 5 <> 1")
def street_number(spark, d):
    i = F.col("page_id")
    ico, label = F.lpad(i.cast("string"), 8, "0").alias("ico"), F.when(i % 5 == 0, "").when(i % 5 == 1, "OLA online s.r.o., ").otherwise("Alo systémy, s.r.o., ")
    rows = T.table(spark, d, "pages")
    shown = rows.select(ico, i.alias("page_ord"), F.concat(pages.page_text(F.col("html")), F.lit(". " + "-" * 90), label, F.lit("MASARYKOVA "), (i + F.when(i % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("/9, Bukov")).alias("text"))
    firms = rows.select(ico, F.lit("ALO systémy s.r.o.").alias("name"), F.when(i % 2 == 0, "Masarykova").otherwise("").alias("street"), F.lit("Masarykova").alias("town"), i.alias("number"))
    return people.street_number(shown, firms).select("ico", "page_ord")
