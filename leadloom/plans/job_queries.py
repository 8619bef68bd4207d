"""Queries of whole jobs: certificates, contacts, complete dossiers, the index as files, facet documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.operators import certificates as certs
from leadloom.operators import contacts, dossier, facets
from leadloom.plans import catalogue as C
from leadloom.plans import fixtures as T
from leadloom.plans.catalogue import query
from leadloom.plans.fixtures import with_sql
from leadloom.plans.more_queries import turnover_notes
from leadloom.sources import index_files
from leadloom.sources.store import materialize, shared_dir

#: What is printed at the end of some texts: several standards, an issuer, numbers beside dates, a label without a number.
STATED = (
    "We hold CSN EN ISO 9001 and ISO/IEC 27001, issued by Bureau  Veritas.", "IATF-16949 since 2020.", "Registration: certificate no 2022-05-19 31150274 OHS18 for ISO 14001, TÜV NORD.",
    "reg. no 12-5-2024 for EN 1090-2 only.", "Certificate number CZ-12345678 iso 9001 DQS", "",
)


def of_companies(rows, only):
    """``rows`` of the companies of ``only`` (a few keys, so that a scan takes them out before any join); all of them where there is no ``only``."""
    return rows if only is None else rows.where(F.col("ico").isin(list(only)))


def written(rows, only):
    """What is read or made for the companies of ``only``, written once, so that no plan holds all sides; as it is where there is no ``only``."""
    return rows if only is None else materialize(rows, "some")


def stated(spark, d):
    """ico, id, kind, text: documents, three to a company, with a sentence on certificates; every fourth is a stored certificate."""
    i = F.col("doc_id")
    said = F.get(F.array(*map(F.lit, STATED)), (i % len(STATED)).cast("int"))
    return T.table(spark, d, "documents").select(
        F.lpad(F.floor(i / 3).cast("string"), 8, "0").alias("ico"), i.alias("id"), F.when(i % 4 == 0, "certificate").otherwise("website").alias("kind"), F.concat_ws(" ", "text", said).alias("text")
    )


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


_SAID = "SELECT lpad(CAST(doc_id // 3 AS VARCHAR), 8, '0') AS ico, doc_id AS id, doc_id % 4 = 0 AS stored, concat_ws(' ', text, (" + T._list(STATED) + ")[CAST(doc_id % 6 + 1 AS INTEGER)]) AS text FROM documents"
_NAMED = "SELECT ico, id, stored, text, standard, m, strpos(text, m) AS spot FROM (SELECT *, regexp_extract(text, pattern, 0) AS m FROM said, (VALUES " + ", ".join(f"('{n}', '{_sql_pattern(p)}')" for n, p in certs.STANDARDS) + ") v(standard, pattern)) WHERE m <> '' AND (NOT stored OR length(text) >= 200)"
_TOKENS = f"regexp_extract_all(substr(text, strpos(text, l) + length(l), 220), '{_sql_pattern(certs.NUMBER_SHAPE)}', 1)"
_TIDY = "regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^[ .\\-/]+|[ .\\-/]+$', '', 'g')"
_DATE = _sql_pattern(certs.DATE_SHAPE)
CERTIFICATES = {
    "said": _SAID, "named": _NAMED,
    "numbers": f"SELECT id, list_filter(list_transform({_TOKENS}, lambda t: {_TIDY}), lambda t: NOT regexp_matches(trim(regexp_extract(t, '^[\\d\\s/\\-.]+', 0)), '{_DATE}') AND NOT regexp_matches(t, '{_DATE}') AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 5)[1] AS number FROM (SELECT id, text, regexp_extract(text, '{_sql_pattern(certs.NUMBER_LABEL)}', 0) AS l FROM said) WHERE l <> ''",
    "cut": f"SELECT n.*, trim(substr(n.text, greatest(1, spot - 80), spot + length(m) + 80 - greatest(1, spot - 80)), chr(10) || chr(9) || chr(13) || chr(160) || ' ') AS quote, nullif(regexp_replace(regexp_extract(n.text, '{_sql_pattern(certs.ISSUERS)}', 0), '\\s+', ' ', 'g'), '') AS issuer FROM named n",
    "found": """SELECT ico, standard, CAST(NULL AS VARCHAR) AS number, issuer, 'page' AS tier, quote, id AS snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY ico, standard ORDER BY id) AS r FROM cut WHERE NOT stored) WHERE r = 1
        UNION ALL SELECT ico, standard, number, issuer, 'pdf', quote, cut.id FROM cut LEFT JOIN numbers ON numbers.id = cut.id WHERE stored
        UNION ALL SELECT ico, NULL, NULL, NULL, 'scanned', NULL, id FROM said WHERE stored AND length(text) < 200""",
}


def found_certificates(rows):
    return certs.certificates(rows.where("kind = 'website'"), rows.where("kind = 'certificate'"))


@query("q134_certificates", with_sql("SELECT * FROM found", **CERTIFICATES))
def certificates(spark, d):
    return found_certificates(stated(spark, d))


def kept_certificates(spark, d):
    """An older file: one certificate of every company."""
    return T.company(spark, d).select("ico", F.lit("ISO 9001").alias("standard"), F.lit(None).cast("string").alias("number"), F.lit("file").alias("tier"), F.lit(None).cast("string").alias("quote"))


def listed_certificates(spark, d, only=None):
    rows = written(of_companies(stated(spark, d), only), only)
    claims = certs.certificate_claims(found_certificates(rows), rows).withColumn("claim_id", F.col("snapshot_id")).withColumn("relevance", F.lit(None).cast("string"))
    return certs.company_certificates(claims, of_companies(kept_certificates(spark, d), only))


LISTED = {
    **CERTIFICATES,
    "listed_certificates": """SELECT ico, standard, number, tier FROM (SELECT *, row_number() OVER (PARTITION BY ico, standard ORDER BY snapshot_id) AS r FROM found WHERE standard IS NOT NULL) WHERE r = 1
        UNION ALL SELECT ico, 'ISO 9001', NULL, 'file' FROM company WHERE ico NOT IN (SELECT ico FROM found WHERE standard IS NOT NULL)""",
}


@query("q135_company_certificates", with_sql("SELECT * FROM listed_certificates", "company", **LISTED))
def company_certificates(spark, d):
    return listed_certificates(spark, d).drop("quote")


#: Rows of contact pages that stand before the documents' own texts.
PRINTED = (
    "Petr Dvořák jednatel dvorak@firma.cz +420 777 123 456 info@firma.cz efaktury@firma.cz ", "Jana Malá vedoucí výroby mala@skupina.eu obchod@skupina.eu 605 111 222 ", "firma@firma.cz novak@seznam.cz alfastroje@seznam.cz ",
    "Pavel Kos obchodní kos@cizi.cz 595 223 218 ", "Sekretariat@Mail.Firma.cz firma@firma.eu spam@firma.cz ", "",
)


def contact_pages(spark, d):
    """ico, page_ord, kind, text: documents, two to a company, after a row of a contact table."""
    i = F.col("doc_id")
    row = F.get(F.array(*map(F.lit, PRINTED)), (i % len(PRINTED)).cast("int"))
    kind = F.get(F.array(*map(F.lit, ("home", "contact", "about", "other", "career"))), (i % 5).cast("int"))
    return T.table(spark, d, "documents").select(F.lpad(F.floor(i / 2).cast("string"), 8, "0").alias("ico"), i.alias("page_ord"), kind.alias("kind"), F.concat(row, F.coalesce("text", F.lit(""))).alias("text"))


def contact_sites(spark, d):
    """A site for each company that has pages; every seventh isn't proven."""
    firms = T.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("k")).distinct()
    return firms.select(F.lpad(F.col("k").cast("string"), 8, "0").alias("ico"), F.lit("ALFA stroje s.r.o.").alias("name"), F.lit("Brno").alias("city"), F.lit("firma.cz").alias("domain"), F.when(F.col("k") % 7 == 0, "probable").otherwise("proven").alias("status"))


def board(spark, d):
    """People of the register, two to a company; some have a namesake, one is named as the company."""
    k, firms = F.col("k"), T.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("k")).distinct()
    person = lambda name, role, born: F.struct(F.lit(name).alias("name"), F.lit(role).alias("role"), born.alias("born"))
    people = F.array(
        person("DVOŘÁK Petr", "jednatel", F.lit("1960")), person("Petr Dvořák", "jednatel", F.lit("1960")), person("Jana Malá", "prokurista", F.when(k % 5 == 0, "1971").otherwise("1980")),
        person("Jana Malá", "společník", F.lit("1980")), person("Adam Alfa", "jednatel", F.lit("1950")),
    )
    return firms.select(F.lpad(k.cast("string"), 8, "0").alias("ico"), F.inline(people))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_FREE = C._in(contacts.FREE_HOSTS)
_LOCAL, _BARE = "split_part(address, '@', 1)", "regexp_replace(split_part(address, '@', 1), '[^a-z0-9]', '', 'g')"
ADDRESSES = {
    "page": "SELECT doc_id // 2 AS k, doc_id AS page_ord, (" + T._list(PRINTED) + ")[CAST(doc_id % 6 + 1 AS INTEGER)] || coalesce(text, '') AS text FROM documents",
    "every_mail": f"SELECT k, page_ord, CAST(pos AS BIGINT) AS pos, lower(a) AS address, split_part(lower(a), '@', -1) AS host FROM (SELECT k, page_ord, unnest(l) AS a, unnest(range(len(l))) AS pos FROM (SELECT k, page_ord, regexp_extract_all(text, '{_MAIL}') AS l FROM page WHERE k % 7 <> 0))",
    "most": f"SELECT page_ord, host AS shared FROM (SELECT *, row_number() OVER (PARTITION BY page_ord ORDER BY n DESC, p) AS r FROM (SELECT page_ord, host, count(*) AS n, min(pos) AS p FROM every_mail GROUP BY 1, 2)) WHERE r = 1 AND n >= 2 AND host NOT IN {_FREE}",
    "own_mail": f"""SELECT k, page_ord, min(pos) AS pos, address FROM every_mail LEFT JOIN most USING (page_ord) WHERE host = 'firma.cz' OR host LIKE '%.firma.cz' OR split_part(host, '.', 1) = 'firma'
        OR host = shared OR ends_with(host, '.' || shared) OR split_part(host, '.', 1) = split_part(shared, '.', 1) OR (host IN {_FREE} AND {_BARE} <> '' AND (contains('alfastroje', {_BARE}) OR contains({_BARE}, 'alfastroje'))) GROUP BY k, page_ord, address""",
}


@query("q136_page_addresses", with_sql(f"""SELECT lpad(CAST(k AS VARCHAR), 8, '0') AS ico, page_ord, CAST(pos AS INTEGER) AS pos, address, CAST(CASE WHEN {_BARE} = 'firma' THEN 0 WHEN {_LOCAL} IN {C._in(contacts.SELLING)} OR regexp_extract({_LOCAL}, '^[^._-]*', 0) IN {C._in(contacts.SELLING)} THEN 1
    WHEN {_LOCAL} IN {C._in(contacts.BACK_OFFICE)} OR regexp_extract({_LOCAL}, '^[^._-]*', 0) IN {C._in(contacts.BACK_OFFICE)} THEN 3 ELSE 2 END AS INTEGER) AS desk FROM own_mail""", **ADDRESSES))  # fmt: skip
def page_addresses(spark, d):
    proven = contact_sites(spark, d).where("status = 'proven'")
    return contacts.page_addresses(contact_pages(spark, d), proven).drop("personal")


@query("q137_company_contacts")
def company_contacts(spark, d):
    return contacts.company_contacts(contact_pages(spark, d), contact_sites(spark, d), board(spark, d))


@query("q138_best_contacts")
def best_contacts(spark, d):
    found = contacts.company_contacts(contact_pages(spark, d), contact_sites(spark, d), board(spark, d))
    return found.select("ico", contacts.best_contact().alias("c")).where("c is not null").select("ico", "c.*")


def complete(spark, d, only=None):
    """Dossiers with every side, of all companies or of those of ``only``: each side is one company's own, so others' rows go before anything is read off them."""
    of = lambda rows: of_companies(rows, only)
    once = lambda rows: written(rows, only)
    files = once(dossier.dossiers(of(T.company(spark, d).select("ico", "name")), once(of(T.claim(spark, d)))))
    reached = once(contacts.company_contacts(once(of(contact_pages(spark, d))), once(of(contact_sites(spark, d))), once(of(board(spark, d)))))
    listed = once(listed_certificates(spark, d, only))
    jobs = of(T.vacancies(spark, d)[1].select("ico", "date", "title"))
    return dossier.complete(files, of(T.website(spark, d).select("ico", "domain", "status")), reached, of(turnover_notes(spark, d)), listed, jobs)


@query("q139_complete_dossiers", with_sql("""SELECT c.ico, w.domain, m.value_czk, coalesce(s.said, '') AS standards, coalesce(v.said, '') AS vacancies FROM company c
    LEFT JOIN (SELECT ico, min(domain) AS domain FROM website GROUP BY ico) w ON w.ico = c.ico
    LEFT JOIN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ico, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 1000 END AS value_czk FROM customer) m ON m.ico = c.ico
    LEFT JOIN (SELECT ico, string_agg(standard || ' ' || coalesce(number, '-') || ' ' || tier, ';' ORDER BY standard) AS said FROM listed_certificates GROUP BY ico) s ON s.ico = c.ico
    LEFT JOIN (SELECT ico, string_agg(date || ' ' || title, ';' ORDER BY date DESC, title DESC) AS said FROM vacancy GROUP BY ico) v ON v.ico = c.ico""", "company", "website", "vacancy", **LISTED))
def complete_dossiers(spark, d):
    standards = F.transform("certificates", lambda c: F.concat_ws(" ", c["standard"], F.coalesce(c["number"], F.lit("-")), c["tier"]))
    posted = F.transform("vacancies", lambda v: F.concat_ws(" ", v["date"].cast("string"), v["title"]))
    return complete(spark, d).select("ico", F.col("website.domain").alias("domain"), F.col("turnover.value_czk").alias("value_czk"), F.array_join(standards, ";").alias("standards"), F.array_join(posted, ";").alias("vacancies"))


@query("q140_delivery")
def delivery(spark, d):
    """The week's lines: companies of the week that somebody can be reached at.  Dossiers are made of the week's companies only."""
    picked = materialize(C.week(spark, d), "week")
    return dossier.delivery(picked, complete(spark, d, [r.ico for r in picked.select("ico").collect()])).select("place", "ico", F.to_json("line").alias("line"))


@query("q141_index_files", with_sql("SELECT ico, CASE WHEN nace <> '' AND substr(nace, 1, 2) < '50' THEN upper(name) ELSE name END AS name, nace AS code, substr(nace, 1, 2) AS division FROM company", "company"))
def index_rows(spark, d):
    """The index as files, after the divisions below 50 were replaced."""
    rows = T.company(spark, d).select("ico", "name", F.col("nace").alias("code"), F.nullif(F.substring("nace", 1, 2), F.lit("")).alias("division"))
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index_files.write_index(rows, folder)
    index_files.write_index(rows.where("division < '50'").withColumn("name", F.upper("name")), folder)
    return index_files.read_index(spark, folder, rows.schema).withColumn("division", F.coalesce("division", F.lit("")))


@query("q142_facet_documents", with_sql("SELECT 'size' AS part, code, n, CAST(pos AS INTEGER) AS pos FROM (SELECT b.code, b.pos, count(ico) AS n FROM (SELECT unnest(" + T._list(T.BANDS) + ") AS code, unnest(range(10)) AS pos) b LEFT JOIN company ON band = b.code GROUP BY 1, 2) UNION ALL SELECT 'region', code, n, CAST(row_number() OVER (ORDER BY n DESC, code) - 1 AS INTEGER) FROM (SELECT substr(district, 1, 5) AS code, count(*) AS n FROM company GROUP BY 1)", "company"))
def facet_documents(spark, d):
    firms = T.company(spark, d)
    bands = spark.createDataFrame([(n, b, b) for n, b in enumerate(T.BANDS)], "pos int, code string, label string")
    sizes = facets.size_document(firms, bands).select(F.lit("size").alias("part"), F.posexplode("sizes").alias("pos", "r"))
    names = T.table(spark, d, "nation").select(F.concat(F.lit("CZ0"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name"))
    regions = facets.region_document(firms, names).select(F.lit("region").alias("part"), F.posexplode("regions").alias("pos", "r"))
    flat = lambda rows: rows.select("part", F.col("r.code").alias("code"), F.col("r.n").alias("n"), "pos")
    return flat(sizes).unionByName(flat(regions))


@query("q143_place_points", with_sql("SELECT lpad(CAST(pos % 40 AS VARCHAR), 3, '0') AS code, round(avg(lon) + CASE WHEN pos % 40 < 10 THEN 1 ELSE 0 END, 5) AS lon, round(avg(lat), 5) AS lat FROM site GROUP BY pos % 40", "site"))
def place_points(spark, d):
    """Outlines from the points of sites, forty places; the second layer moves the first ten east."""
    rows = T.site(spark, d).groupBy(F.lpad((F.col("pos") % 40).cast("string"), 3, "0").alias("code")).agg(F.array(F.collect_list(F.array("lon", "lat"))).alias("rings"))
    east = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p[0] + 1, p[1])))
    return facets.place_points(rows, rows.where("code < '010'").select("code", east.alias("rings")))
