"""Answers of the four registers (JSON texts) as one nested row a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.identity import merge_registers, primary_record, split_by_end

# The fields of the registers' answers that are read.
_PERSON = "titulPredJmenem string, jmeno string, prijmeni string"
_COUNTRY = "adresa struct<kodStatu:string>"
_NAMED = _PERSON.replace(" string", ":string")
_NATURAL = f"fyzickaOsoba struct<{_NAMED},datumNarozeni:string,adresa:struct<kodStatu:string>>"
_MEMBER = f"struct<datumZapisu:string,datumVymazu:string,clenstvi:struct<funkce:struct<nazev:string>>,{_NATURAL.replace(' ', ':', 1)}>"
_HOLDER = f"struct<datumZapisu:string,datumVymazu:string,osoba:struct<{_NATURAL.replace(' ', ':', 1)},pravnickaOsoba:struct<obchodniJmeno:string,adresa:struct<kodStatu:string>>>>"
_SITE = "struct<icp:string,nazev:string,platnostOd:string,sidloProvozovny:struct<textovaAdresa:string,kodAdresnihoMista:long,nazevObce:string,nazevOkresu:string,nazevKraje:string>>"
_TRADE = f"struct<predmetPodnikani:string,datumZaniku:string,odpovedniZastupci:array<struct<{_NAMED},platnostDo:string>>,provozovny:array<{_SITE}>>"
SUMMARY = (
    "obchodniJmeno string, pravniForma string, sidlo struct<nazevObce:string,nazevOkresu:string,nazevKraje:string,kodAdresnihoMista:long,nazevUlice:string,cisloDomovni:int,psc:int>, "
    "seznamRegistraci struct<stavZdrojeIr:string>, dalsiUdaje array<struct<datovyZdroj:string,spisovaZnacka:string>>, datumVzniku string, datumAktualizace string"
)
STATISTICS = "zaznamy array<struct<primarniZaznam:boolean,statistickeUdaje:struct<kategoriePoctuPracovniku:string>,czNacePrevazujici:string>>"
PUBLIC = f"zaznamy array<struct<primarniZaznam:boolean,statutarniOrgany:array<struct<clenoveOrganu:array<{_MEMBER}>>>,spolecnici:array<struct<spolecnik:array<{_HOLDER}>>>>>"
TRADES = f"zaznamy array<struct<primarniZaznam:boolean,zivnosti:array<{_TRADE}>,angazovaneOsoby:array<struct<{_NAMED},typAngazma:string>>,provozovnyStav:struct<pocetAktivnich:int,pocetCelkem:int>>>"
ENDPOINTS = {"summary": "ekonomicke-subjekty", "statistics": "ekonomicke-subjekty-res", "public": "ekonomicke-subjekty-vr", "trades": "ekonomicke-subjekty-rzp"}


def full_name(person: Column) -> Column:
    """Title, first and last name, whatever is there; null if nothing is."""
    parts = [F.nullif(person[x], F.lit("")) for x in ("titulPredJmenem", "jmeno", "prijmeni")]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def _all(lists: Column, inner: str) -> Column:
    """The inner lists of a list of structs, joined; missing lists are empty."""
    return F.flatten(F.transform(F.coalesce(lists, F.array()), lambda x: F.coalesce(x[inner], F.array())))


def _dated(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_by(rows: Column, key: str) -> Column:
    """Of rows with one value of ``key`` the first; null is a value."""
    mark = lambda x: F.coalesce(x[key].cast("string"), F.lit("\u0000"))
    # One variable for the keys: an expression named in a lambda is computed once.
    return F.flatten(F.transform(F.array(F.transform(rows, mark)), lambda keys: F.filter(rows, lambda x, i: F.array_position(keys, mark(x)) == i + 1)))


def summary(answers: DataFrame) -> DataFrame:
    """ico and a company's identity, address and insolvency; ``body`` null or ``null`` gives nulls."""
    d = F.from_json("body", SUMMARY)
    rows = answers.select("ico", d.alias("d"))
    state = F.nullif(F.col("d.seznamRegistraci.stavZdrojeIr"), F.lit(""))
    file = F.get(F.filter("d.dalsiUdaje", lambda x: x["datovyZdroj"] == "vr"), 0)["spisovaZnacka"]
    named = {
        "name": "obchodniJmeno", "legal_form": "pravniForma", "city": "sidlo.nazevObce", "district": "sidlo.nazevOkresu", "region": "sidlo.nazevKraje", "address_code": "sidlo.kodAdresnihoMista",
        "street": "sidlo.nazevUlice", "house_number": "sidlo.cisloDomovni", "postcode": "sidlo.psc", "established": "datumVzniku", "updated": "datumAktualizace",
    }
    return rows.select("ico", *[F.col(f"d.{v}").alias(k) for k, v in named.items()], F.col("d.seznamRegistraci.stavZdrojeIr").alias("insolvency_state"), (state == "AKTIVNI").alias("insolvent"), file.alias("file_number"))


def statistics(answers: DataFrame) -> DataFrame:
    """ico, employee_code and nace of the primary record."""
    rows = answers.select("ico", primary_record(F.from_json("body", STATISTICS)["zaznamy"], "primarniZaznam").alias("r"))
    return rows.select("ico", F.col("r.statistickeUdaje.kategoriePoctuPracovniku").alias("employee_code"), F.col("r.czNacePrevazujici").alias("nace"))


def public_register(answers: DataFrame) -> DataFrame:
    """ico, directors and owners that are still there, and those that have left; null without a record."""
    rows = answers.select("ico", primary_record(F.from_json("body", PUBLIC)["zaznamy"], "primarniZaznam").alias("r"))

    def director(m: Column) -> Column:
        p = m["fyzickaOsoba"]
        return F.struct(
            full_name(p).alias("name"), m["clenstvi"]["funkce"]["nazev"].alias("role"), m["datumZapisu"].alias("since"), p["datumNarozeni"].alias("born"), _dated(p["adresa"]["kodStatu"]).alias("country"), _dated(m["datumVymazu"]).alias("until")
        )

    def owner(m: Column) -> Column:
        p, legal = m["osoba"]["fyzickaOsoba"], m["osoba"]["pravnickaOsoba"]
        return F.struct(
            F.coalesce(full_name(p), legal["obchodniJmeno"]).alias("name"), m["datumZapisu"].alias("since"), _dated(p["datumNarozeni"]).alias("born"), legal.isNotNull().alias("is_legal_entity"),
            _dated(legal["adresa"]["kodStatu"]).alias("country"), _dated(m["datumVymazu"]).alias("until"),
        )

    split = rows.select(
        "ico", F.col("r").isNotNull().alias("known"),
        split_by_end(F.transform(_all(F.col("r.statutarniOrgany"), "clenoveOrganu"), director)).alias("d"), split_by_end(F.transform(_all(F.col("r.spolecnici"), "spolecnik"), owner)).alias("o"),
    )
    shown = {"directors": "d.current", "departed_directors": "d.departed", "owners": "o.current", "departed_owners": "o.departed"}
    return split.select("ico", *[F.when(F.col("known"), F.col(v)).alias(k) for k, v in shown.items()])


def trade_register(answers: DataFrame) -> DataFrame:
    """ico, active trades, ongoing representatives of all trades, persons, sites (first of each number) and their counts."""
    rows = answers.select("ico", primary_record(F.from_json("body", TRADES)["zaznamy"], "primarniZaznam").alias("r"))
    trades = F.coalesce(F.col("r.zivnosti"), F.array())
    active = F.transform(F.filter(trades, lambda t: _dated(t["datumZaniku"]).isNull()), lambda t: t["predmetPodnikani"])
    ongoing = F.flatten(F.transform(trades, lambda t: F.transform(
        F.filter(F.coalesce(t["odpovedniZastupci"], F.array()), lambda p: _dated(p["platnostDo"]).isNull()), lambda p: F.struct(full_name(p).alias("name"), t["predmetPodnikani"].alias("trade"))
    )))
    involved = F.transform(F.coalesce(F.col("r.angazovaneOsoby"), F.array()), lambda p: F.struct(full_name(p).alias("name"), p["typAngazma"].alias("engagement")))

    def site(s: Column) -> Column:
        seat = s["sidloProvozovny"]
        return F.struct(
            s["icp"].alias("icp"), s["nazev"].alias("name"), seat["textovaAdresa"].alias("address"), seat["kodAdresnihoMista"].alias("address_code"), seat["nazevObce"].alias("municipality"),
            seat["nazevOkresu"].alias("district"), seat["nazevKraje"].alias("region"), s["platnostOd"].alias("since"),
        )

    sites = F.transform(first_by(_all(F.col("r.zivnosti"), "provozovny"), "icp"), site)
    made = {"trades": active, "responsible_representatives": ongoing, "involved_persons": involved, "establishments": sites}
    return rows.select(
        "ico", *[F.when(F.col("r").isNotNull(), v).alias(k) for k, v in made.items()],
        F.col("r.provozovnyStav.pocetAktivnich").alias("establishments_active"), F.col("r.provozovnyStav.pocetCelkem").alias("establishments_total"),
    )


def companies(answers: DataFrame) -> DataFrame:
    """One row a company with a struct for each register, null where it has no answer.

    ``answers``: ico, endpoint, fetched_at, body; the last answer of each endpoint counts.
    They are gathered to one row a company by one aggregate, so the registers need no joins
    of their own on large tables; ``merge_registers`` then only lays out what is there.
    """
    last = answers.groupBy("ico").agg(*[F.max_by("body", F.when(F.col("endpoint") == e, F.col("fetched_at"))).alias(n) for n, e in ENDPOINTS.items()])
    parsed = last
    for name, parse in (("summary", summary), ("statistics", statistics), ("public", public_register), ("trades", trade_register)):
        parsed = _in_place(parsed, name, parse)
    return parsed


def _in_place(rows: DataFrame, name: str, parse) -> DataFrame:
    """``rows`` with the text in column ``name`` parsed to a struct, in the same pass."""
    made = parse(rows.select(F.struct(*rows.columns).alias("ico"), F.col(name).alias("body")))
    told = F.col("ico")[name]
    known = told.isNotNull() & (F.trim(told) != "null")
    return made.select(*[F.col("ico")[c].alias(c) for c in rows.columns if c != name], F.when(known, F.struct(*[c for c in made.columns if c != "ico"])).alias(name))


def companies_of_tables(keys: DataFrame, answers: DataFrame) -> DataFrame:
    """:func:`companies` where each register's answers are landed as a table of their own: left joins on the company."""
    parts = {"summary": summary, "statistics": statistics, "public": public_register, "trades": trade_register}
    return merge_registers(keys, {n: parse(answers.where((F.col("endpoint") == ENDPOINTS[n]) & F.col("body").isNotNull()).groupBy("ico").agg(F.max_by("body", "fetched_at").alias("body"))) for n, parse in parts.items()})
