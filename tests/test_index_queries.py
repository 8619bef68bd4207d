"""The index, feed and page queries against their SQL or a plain reading of the same texts."""

import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/root/repo")
from leadloom.operators import people, study  # noqa: E402
from leadloom.plans import catalogue as C  # noqa: E402
from leadloom.plans import index_queries as Q  # noqa: E402,F401

from conftest import SF  # noqa: E402

NAMES = ["q116_register_dates", "q117_vacancy_ceiling", "q118_base_rate", "q119_feed_overlap", "q120_company_index", "q121_division_documents", "q123_street_number"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "part", "events", "pages", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = C.QUERIES[name](spark, SF).toPandas()
    want = con.execute(C.SQL[name]).df()[list(got.columns)]
    key = lambda df: sorted(tuple("" if v is None or v != v else str(round(v, 9) if isinstance(v, float) else v)[:19] for v in r) for r in df.itertuples(index=False))
    a, b = ([tuple(re.sub(r"( 00:00:00|\.0)$", "", v) for v in r) for r in key(x)] for x in (got, want))
    assert len(a) > 0 and sorted(a) == sorted(b)


def plain_people(text, domain, city, known):
    """The rule read from its description, over Python's own patterns."""
    fold = lambda s: "".join(Q.X.PLAIN[Q.X.MARKED.index(c)] if c in Q.X.MARKED else c for c in s.lower())
    role = re.compile(people.PAGE_ROLE.replace("(?iu)", "(?i)"))
    name = re.compile(people.PAGE_NAME)

    def person(m):
        both = [fold(m.group(1)), fold(m.group(2))]
        return not any(w.startswith(s) for w in both for s in people.NOT_A_NAME) and not (city and fold(city) in " ".join(both))

    out = {}
    for m in role.finditer(text):
        before = list(name.finditer(text[max(0, m.start() - 70) : m.start()]))
        if not before or not person(before[-1]):
            continue
        given, surname = before[-1].groups()
        key = tuple(sorted((fold(given), fold(surname))))
        row = text[m.start() : m.start() + 130]
        cuts = [n.start() + 1 for n in name.finditer(row[1:]) if not any(fold(w).startswith(s) for w in n.groups() for s in people.NOT_A_NAME)]
        row = row[: cuts[0]] if cuts else row
        mails = [a for a in re.findall(people.EMAIL, row) if (a.split("@")[1] == domain or a.split("@")[1] in people.FREEMAIL) and fold(surname) in fold(a.split("@")[0])]
        phones = re.findall(people.PHONE, row)
        if key not in known and key not in out and (mails or phones):
            out[key] = (f"{given} {surname}", m.group(0), mails[0] if mails else None, phones[0] if phones else None)
    return out


def test_page_people_against_a_plain_reading(spark):
    rows = Q.printed(spark, SF)
    known = {r.ico: r.name for r in C.T.table(spark, SF, "customer").select(F.lpad("c_custkey", 8, "0").alias("ico"), F.when(F.col("c_custkey") % 3 == 0, "x").alias("name")).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.page_ord):
        found = plain_people(r.text, r.domain, r.city, {("dvorak", "petr")} if known.get(r.ico) else set())
        for k, v in found.items():
            want.setdefault((r.ico, k), v)
    got = C.QUERIES["q122_page_people"](spark, SF).collect()
    assert sorted((r.ico, r.name, r.role, r.email or "", r.phone or "") for r in got) == sorted((i, *(x or "" for x in v)) for (i, _), v in want.items())
    assert {r.source for r in got} == {"page", "page_weak"}


def test_page_people_odd_texts(spark):
    schema = "ico string, page_ord int, text string, domain string, city string"
    rows = [("1", 1, None, None, None), ("1", 2, "", "a.cz", ""), ("2", 1, "Jana Malá vedoucí " * 3 + "605 111 222", None, None), ("2", 1, "Jana Malá vedoucí 605 111 222", None, None)]
    got = people.page_people(spark.createDataFrame(rows, schema), spark.createDataFrame([], "ico string, name string")).collect()
    assert [(r.ico, r.name, r.phone, r.source) for r in got] == [("2", "Jana Malá", "605 111 222", "page_weak")]


def test_street_number_needs_its_own_name(spark):
    pages = [("1", 1, "Sídlo: Rumpold s.r.o., Dlouhá 5, Brno"), ("1", 2, "Naše firma, Dlouhá 5"), ("1", 3, "Dlouhá 55"), ("1", 4, None)]
    got = people.street_number(spark.createDataFrame(pages, "ico string, page_ord int, text string"), spark.createDataFrame([("1", "Alo s.r.o.", "Dlouhá", "5", "Brno")], "ico string, name string, street string, number string, town string")).collect()
    assert [(r.page_ord, r.quote) for r in got] == [(2, "Naše firma, Dlouhá 5")]


def test_vacancy_ceiling_tenth(spark):
    jobs = spark.createDataFrame([("1", "2024-01-30", "1311")] + [("2", "2024-01-25", "9")] * 3 + [("3", "2023-01-01", "9")], "ico string, date string, occupation string").withColumn("date", F.to_date("date"))
    firms = spark.createDataFrame([("1", "130"), ("2", "999"), ("3", "120")], "ico string, band string")
    got = study.vacancy_ceiling(jobs, firms, ("1311",), (2, 7), "2024-01-31").orderBy("width").collect()
    assert [tuple(r) for r in got] == [(2, 1, 0, 1, 1), (7, 2, 1, 1, 1)]
