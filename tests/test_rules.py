"""Rules with several branches, each branch on a row of its own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.operators import audit, evidence, events, identity, pages, select, study


def one(spark, column, **named):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in named.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, shown",
    [
        ("IČ 255 09 900.", True), ("IČO: 25509900", True), ("dič cz25509900", True), ("CZ 255 09 900", True), ("call 2550 or room 9900", False),
        ("255099001", False), ("2550990", False), ("x 25.50.99.00 x", True), ("", False),
    ],
)
def test_number_on_a_page(spark, text, shown):
    assert one(spark, pages.shows_number(F.col("t"), F.col("i")), t=text, i="25509900") is shown


def test_number_without_leading_zeros(spark):
    assert one(spark, pages.shows_number(F.col("t"), F.col("i")), t="IČ 12 345 67 89", i="00123456") is False
    assert one(spark, pages.shows_number(F.col("t"), F.col("i")), t="IČ 1234567 a", i="01234567") is False  # a run has eight characters at least
    assert one(spark, pages.shows_number(F.col("t"), F.col("i")), t="IČ 123 4567 a", i="01234567") is True


def test_mode_verdicts(spark):
    rows = [
        ("stated", "serial", "direct", 2, "web"), ("stated", "made_to_order", "structural", 9, "web"),
        ("two", "serial", "direct", 1, "web"), ("two", "small_batch", "direct", 1, "vacancy"),
        ("said", "mixed", "direct", 1, "web"),
        ("leans", "made_to_order", "structural", 2, "web"), ("leans", "serial", "structural", 1, "web"),
        ("other", "serial", "structural", 1, "web"),
        ("tie", "made_to_order", "structural", 1, "web"), ("tie", "serial", "structural", 1, "web"),
    ]
    found = spark.createDataFrame(rows, "ico string, side string, kind string, hits int, source string")
    firms = spark.createDataFrame([(x,) for x in ("stated", "two", "said", "leans", "other", "tie", "silent")], "ico string")
    got = {r.ico: (r.mode, r.basis) for r in evidence.mode_verdict(found, firms).collect()}
    assert got == {
        "stated": ("serial", "direct"), "two": ("mixed", "direct"), "said": ("mixed", "direct"), "leans": ("leaning_made_to_order", "structural"),
        "other": ("leaning_serial", "structural"), "tie": ("unknown", "structural_tie"), "silent": ("unknown", None),
    }
    strict = {r.ico: r.mode for r in evidence.mode_verdict(found, allow_mixed=False, source_rank={"vacancy": 2, "web": 1}).collect()}
    assert strict["two"] == "small_batch" and strict["stated"] == "serial"


def test_registrant_tiers(spark):
    firms = spark.createDataFrame([("1", "AB-C s.r.o.", "10000"), ("2", "Steelcase Czech", "20000"), ("3", "H & M spol. s r.o.", "30000"), ("4", "Quiet", "40000"), ("5", "Board", "50000")], "ico string, name string, postcode string")
    people = spark.createDataFrame([("5", "Jan Novák")], "ico string, name string")
    rows = [
        ("1", 0, "a.cz", "ABC", "9"), ("2", 0, "s.cz", "Steelcase Czech Holding", "9"), ("3", 0, "h.cz", "H & M Hennes & Mauritz International", "9"), ("4", 0, "q.cz", "Somebody", "40000"),
        ("5", 1, "b.cz", "jan novak", "9"), ("5", 0, "c.cz", "Board", "9"),
    ]
    got = {r.ico: (r.domain, r.tier) for r in identity.registrant_tier(spark.createDataFrame(rows, "ico string, pos int, domain string, registrant string, postcode string"), firms, people).collect()}
    # A long registrant that holds a short company name is no proof; the company's own key has to be long.
    assert got == {"1": ("a.cz", "name"), "2": ("s.cz", "partial"), "4": ("q.cz", "postcode"), "5": ("b.cz", "person")}


def test_marks_of_their_own(spark):
    assert one(spark, identity.registry_key(F.col("n")), n="Dvor\u030ca\u0301k s.r.o.") == "dvorak"


def test_seasons_count_empty_weeks(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 30)), ("a", dt.date(2024, 1, 29)), ("b", dt.date(2024, 1, 30)), ("a", dt.date(2024, 1, 20))], "ico string, date date")
    got = {r.month: r.per_week for r in study.seasonality(study.weekly(rows, "2024-01-31", 6), "2024-01-31").collect()}
    assert got == {1: 3 / 5, 12: 0.0}


def test_person_places_score(spark):
    text = "Tomáš Jupa Jednatel, +420 111 222 333. " + "x " * 80 + "Patrik Jupa Obchod p.jupa@firma.cz. " + "x " * 80 + "Jupa, jednatel"
    page = spark.createDataFrame([("1", 0, text)], "ico string, page_ord int, text string")
    people = spark.createDataFrame([("1", "Patrik Jupa", "a"), ("1", "Tomáš Jupa", "b"), ("1", "Nikdo Tady", "c"), ("1", "Jan Jupa", "d"), ("1", "Jan Jupa", "e")], "ico string, name string, born string")
    got = {r.name: (r.score, r.email, r.phone) for r in pages.person_occurrences(page, people).collect()}
    assert got == {"Patrik Jupa": (7, "p.jupa@firma.cz", None), "Tomáš Jupa": (7, None, "+420 111 222 333")}


def test_reentries_of_one_person(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [(1, "x", "director_departed", "P", d(5)), (2, "x", "owner_joined", "P", d(8)), (3, "x", "owner_joined", "P", d(20)), (4, "x", "owner_departed", "Q", d(5)), (5, "x", "director_joined", None, d(5)), (6, "x", "director_departed", None, d(5)), (7, "x", "other", "P", d(8))]
    moves = spark.createDataFrame(rows, "event_id int, ico string, kind string, name string, date date")
    assert sorted(r.event_id for r in events.drop_reentries(moves).collect()) == [3, 4, 5, 6]
    listed = spark.createDataFrame([("x", "owner", "q")] * 2, "ico string, role string, name string")
    assert sorted(r.event_id for r in events.drop_reentries(moves, listed).collect()) == [3, 5, 6]


def _run(spark):
    """Tables of a run in which every check of the audit is broken once."""
    order = dict.fromkeys(select.ORDERING, 0)
    ranked = [dict(ico=i, place=p, reason="A", **(order | {"age_days": a})) for i, p, a in (("ok", 1, 1), ("code", 2, 2), ("gone", 3, 3), ("still", 4, 9), ("late", 5, 4), ("class", 6, 10))]
    week = [("ok", "proven", True, None, None), ("ok", "proven", True, None, None), ("siteless", "probable", True, "o", dt.date(2024, 1, 1)), ("mute", "proven", None, "o", dt.date(2024, 1, 1))]
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "ranked": spark.createDataFrame(ranked),
        "judged": t([("ok", None, "ok"), ("code", "nace", "ok"), ("gone", None, "exclude")], "ico string, reject_reason string, verdict string"),
        "events": t([(x,) for x in ("ok", "code", "gone", "late", "class")], "ico string"),
        "week": t(week, "ico string, site_status string, has_channel boolean, owner string, owner_date date"),
        "reasons": t([("ok", "A"), ("class", "B")], "ico string, reason string"),
    }


def test_later_checks_of_the_audit_fire(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    run = {
        "km": 150.0, "week": t([("in", 155.0), ("far", 156.0), ("lost", None), ("buys", 1.0)], "ico string, km double"), "events": t([("buys", "subsidy_signed"), ("in", "tender_open")], "ico string, kind string"),
        "buying": t([("buys",), ("in",)], "ico string"), "gated": t([("in", ["no_channel"]), ("odd", ["weather"])], "ico string, problems array<string>"),
        "claims": t([("in", "fact", None), ("guess", "guess", None), ("judged", "fact", "maybe")], "ico string, state string, relevance string"), "delivered": t([("in", 1), ("twice", 2), ("twice", 2)], "ico string, run_id int"),
    }
    found = {name: sorted(r.ico for r in audit.CHECKS[name](run).collect()) for name in ("radius", "buying", "reasons_known", "values")}
    assert found == {"radius": ["far", "lost"], "buying": ["buys"], "reasons_known": ["odd"], "values": ["guess", "judged", "twice"]}
    assert audit.inside_radius({**run, "km": None}).count() == 0


def test_contact_links_rank(spark):
    base = "https://www.firma.cz/"
    rows = [
        (1, base, 0, "/kontakt", "x"), (1, base, 1, "https://firma.cz/cs/kontakt", "again"), (1, base, 2, "https://other.cz/kontakt", "x"), (1, base, 3, "mailto:kontakt@firma.cz", "x"), (1, base, 4, "/o-nas/kontakt-info.html", "x"),
        (1, base, 5, "/kontakt/mapa", "x"), (1, base, 6, "/a", "Kontakt"), (1, base, 7, "/news", "x"),
    ]
    found = spark.createDataFrame(rows, "page_id int, base string, pos int, href string, label string")
    got = [(r.url, r.rank) for r in pages.contact_links(found, "(?i)kontakt", "(?i)^kontakty?$").orderBy("place").collect()]
    assert got == [("https://www.firma.cz/kontakt", 3), ("https://www.firma.cz/a", 2), ("https://www.firma.cz/o-nas/kontakt-info.html", 2), ("https://www.firma.cz/kontakt/mapa", 1)]
    assert [one(spark, pages.contact_order(F.col("k")), k=k) for k in ("contact", "career", "news")] == [0, 3, 9]


def test_each_check_of_the_audit_fires(spark):
    run = _run(spark)
    found = {name: sorted(r.ico for r in check(run).collect()) for name, check in audit.CHECKS.items() if name in audit_names}
    assert found == audit_names


audit_names = {
    "brief": ["code"], "excluded": ["gone"], "event": ["still"], "site": ["siteless"], "channel": ["mute"], "monotone": ["late"], "class": ["class"], "groups": ["mute"], "distinct": ["ok"],
}
