"""Domain guesses, costs, runs, shares, ages and links: cases by hand and a plain reader of names."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leadloom.operators import events, facets, identity, pages, select, study


def plain_stems(name):
    bare = re.sub(identity.FORM_END, "", name, flags=re.IGNORECASE).strip()
    bare = "".join(c for c in unicodedata.normalize("NFD", bare) if not unicodedata.combining(c)).lower()
    every = re.sub("[^a-z0-9]+", " ", bare).split()
    words = [w for w in every if w not in identity.FORM_WORDS] or every
    own = [w for w in words if w not in identity.FILLER] or words
    guesses = [j.join(ws) for ws in (words, own) for j in ("", "-")]
    if len(own) > 2:
        guesses += ["".join(own[:2]), "-".join(own[:2])]
    if len(own) > 1:
        guesses.append(own[0])
    if len(own) > 2:
        guesses.append("".join(w[0] for w in own))
    return list(dict.fromkeys(g for g in guesses if 2 <= len(g) <= 63))


NAMES = [
    "CHARVÁT AXL, a.s.", "VINAMET CZ", "3 P", "AKORD - stavební a obchodní společnost", "ČSAD, s.r.o. Rychnov n. Kn.", "Group CZ", "s.r.o.", "SE spol AG", "", "X", "Texas", "Hengst Air Filtration Czech Republic spol. s r.o.",
    "ÁÉÍ, AKCIOVÁ SPOLEČNOST", "Alfa, společnost s ručením omezeným", "Dlouhé " * 30 + "a. s.", "!!!", "Firma z.ú.", "a b c d",
]


def test_stems_equal_a_plain_reader(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(99, None)], "i int, name string")
    got = {r.i: r.s for r in rows.select("i", identity.domain_stems(F.col("name")).alias("s")).collect()}
    assert got == {i: plain_stems(n) for i, n in enumerate(NAMES)} | {99: []}
    assert got[0] == ["charvataxl", "charvat-axl", "charvat"] and "vinamet" in got[1] and got[6] == [] and got[7] == ["sespolag", "se-spol-ag", "sespol", "se-spol", "se", "ssa"]


def test_foreign_endings_for_the_likeliest_only(spark):
    row = spark.range(1).select(identity.domain_candidates(F.array(F.lit(" www.Firma.cz"), F.lit("..firma.cz"), F.lit("nodot"), F.lit(None)), F.lit("Alfa Beta Gama s.r.o.")).alias("d")).first()
    stems = ["alfabetagama", "alfa-beta-gama", "alfabeta", "alfa-beta", "alfa", "abg"]
    assert row.d == ["firma.cz", *[f"{s}.cz" for s in stems], *[f"{s}.{e}" for s in stems[:3] for e in ("com", "eu")]]
    short = spark.range(1).select(identity.domain_candidates(F.lit(None).cast("array<string>"), F.lit("Alfa"), most=2).alias("d")).first()
    assert short.d == ["alfa.cz", "alfa.com"]


def test_cost_by_mode_and_cached_input(spark):
    calls = spark.createDataFrame(
        [(1, "m", "sync", True, 1_000_000, 0), (2, "m", "sync", False, 1_000_000, 100_000), (3, "m", "batch", True, 1_000_000, 0), (4, "m", "batch", None, None, 5), (5, "other", "sync", False, 9, 9)],
        "id int, model string, mode string, cached boolean, tokens_in long, tokens_out long",
    )
    prices = spark.createDataFrame([("m", "sync", 2.0, 8.0, 0.5), ("m", "batch", 1.0, 4.0, None)], "model string, mode string, price_in double, price_out double, price_cached double")
    costs = facets.call_costs(calls, prices)
    assert {r.id: r.cost for r in costs.collect()} == {1: 0.5, 2: 2.8, 3: 1.0, 4: pytest.approx(0.00002), 5: None}
    total = facets.spent(costs).first()
    assert (total.calls, total.unpriced, total.cost) == (5, 1, 4.3)
    none = facets.spent(costs.where("false")).first()
    assert (none.calls, none.cost) == (0, 0.0)


def test_runs_hold_their_companies(spark):
    shown = spark.createDataFrame([("12", 1, "2024-01-01"), ("00000012", 2, "2024-01-08"), ("99", 2, "2024-01-08")], "ico string, run_id int, delivered_on string")
    known = spark.createDataFrame([("00000012", "Alfa")], "ico string, name string")
    runs = {r.run_id: [(c.ico, c.name, c.times, c.in_candidates) for c in r.companies] for r in select.delivered_runs(shown, known).collect()}
    assert runs == {1: [("00000012", "Alfa", 2, True)], 2: [("00000012", "Alfa", 2, True), ("00000099", None, 1, False)]}
    assert tuple(select.delivery_totals(shown).first()) == (2, 3, 2)


def test_shares_of_owners_and_familiar_people(spark):
    moves = spark.createDataFrame(
        [("1", "owner_joined", "Firma", True), ("1", "owner_departed", "Jan", None), ("1", "director_joined", "JAN", False), ("1", "director_joined", "Eva", False), ("2", "director_joined", "Jan", False), ("1", "director_joined", None, False)],
        "ico string, kind string, name string, legal_entity boolean",
    )
    record = spark.createDataFrame([("1", "owner", "Jan", False), ("1", "director", "Eva", False), ("1", "director", None, True)], "ico string, role string, name string, departed boolean")
    assert tuple(study.owner_shares(moves).first()) == (2, 1, 0.5)
    assert tuple(study.familiar_arrivals(moves, record).first()) == (4, 2, 0.5)
    assert tuple(study.owner_shares(moves.where("false")).first()) == (0, 0, None)
    assert tuple(study.familiar_arrivals(moves.where("false"), record).first()) == (0, 0, None)


def test_events_by_age(spark):
    rows = spark.createDataFrame([("1", "2024-01-01", "b", "x"), ("1", "2024-01-03", "a", "x"), ("1", None, "a", "x"), ("1", "2024-01-01", "a", "x")], "ico string, date string, kind string, name string").withColumn("date", F.col("date").cast("date"))
    got = [(r.place, r.age_days, r.kind) for r in events.by_age(rows, "2024-01-04").orderBy("place").collect()]
    assert got == [(1, 1, "a"), (2, 3, "a"), (3, 3, "b"), (4, None, "a")]


def test_contact_links_by_hint_and_language(spark):
    base = "https://firma.cz/"
    rows = [(1, base, 0, "/o-nas", "x"), (1, base, 1, "/xx/kontakt", "x"), (1, base, 2, "/kontakt", "x"), (1, base, 3, "/PL/kontakt", "x"), (1, base, 4, "/news", "x"), (1, base, 5, "/a", "Údaje")]
    found = spark.createDataFrame(rows, "page_id int, base string, pos int, href string, label string")
    got = [(r.url.removeprefix("https://firma.cz"), r.rank) for r in pages.contact_links(found, hint=pages.CONTACT_HINT).orderBy("place").collect()]
    assert got == [("/kontakt", 3), ("/xx/kontakt", 3), ("/a", 1), ("/o-nas", 1)]


def test_answer_without_any_colon(spark):
    rows = spark.createDataFrame([("a.cz", "no such domain\n\ncontact: A\nname: Alfa\n\nnsset: N\nname: not this"), ("b.cz", "nothing"), ("c.cz", None)], "domain string, text string")
    assert [(r.domain, r.name, r.address) for r in identity.registrant_block(rows).collect()] == [("a.cz", "Alfa", "")]
