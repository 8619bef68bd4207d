"""Documents about companies: event sentences, one dossier a company, the week's catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.contacts import best_contact
from leadloom.operators.evidence import counts, newest_pass, usable

# What is said of people who came and went, and of statements that give no turnover.
VERBS = {
    "director_joined": "nastoupil do statutárního orgánu", "director_departed": "opustil statutární orgán",
    "owner_joined": "stal se vlastníkem", "owner_departed": "přestal být vlastníkem",
}
NOTES = {
    "no_subject": "není ve Sbírce listin", "no_statement": "žádná účetní závěrka za poslední roky", "no_pdf": "podání neobsahuje čitelný soubor",
    "scanned": "závěrka je sken bez textové vrstvy", "no_revenue_row": "podána jen rozvaha, výkaz zisku a ztráty chybí", "found_rows": "nalezeno v PDF, výběr sloupce nepotvrzen",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in values.items() for x in p])


def sentence() -> Column:
    """What is said of an event: columns kind, name, role, date, title, months, days_left, amount, fresh (null where they don't apply)."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    given = lambda x, *parts: F.when(F.col(x).isNotNull(), F.concat(*parts)).otherwise("")
    vacancy = F.concat(
        F.lit("inzerát na řídící/plánovací roli"), given("date", F.lit(", zveřejněno "), text("date")),
        F.when(F.col("months") > 0, F.concat(F.lit(", firma inzeruje v "), text("months"), F.lit(" sledovaných měsících"))).otherwise(""), F.lit(": "), text("title"),
    )
    left = F.when(F.col("days_left") >= 0, F.concat(F.lit(", do uzávěrky "), text("days_left"), F.lit(" dní"))).when(F.col("days_left") < 0, ", po uzávěrce").otherwise("")
    tender = F.concat(F.lit("otevřená zakázka"), left, F.lit(": "), F.substring(text("title"), 1, 90))
    millions = F.concat(F.format_string("%.1f", F.coalesce("amount", F.lit(0.0)).cast("double") / 1e6), F.lit(" mil. Kč"))
    subsidy = F.concat(
        F.lit("podepsaná dotace EU ("), millions, F.lit(")"), given("date", F.lit(", podepsáno "), text("date")),
        F.when(F.coalesce("fresh", F.lit(False)), "").otherwise(" (starší, ověřit stav)"), F.lit(": "), F.substring(text("title"), 1, 90),
    )
    named = F.when(text("name") != "", F.col("name")).otherwise("neuvedeno")
    move = F.concat(named, F.when(text("role") != "", F.concat(F.lit(" ("), F.col("role"), F.lit(")"))).otherwise(""), F.lit(" — "), _map(VERBS)[F.col("kind")])
    return F.when(F.col("kind") == "management_vacancy", vacancy).when(F.col("kind") == "tender_open", tender).when(F.col("kind") == "subsidy_signed", subsidy).otherwise(move)


def turnover(statements: DataFrame) -> DataFrame:
    """ico, status, value_czk (where it was found), note (where it wasn't), state."""
    found = F.col("status") == "found"
    return statements.select(
        "ico", F.coalesce("status", F.lit("not_checked")).alias("status"), F.when(found, F.col("value_czk")).alias("value_czk"), _map(NOTES)[F.col("status")].alias("note"),
        F.when(found, "fact").otherwise("unknown").alias("state"),
    )


def distinct_events(claims: DataFrame) -> DataFrame:
    """The newest pass's events, one of each kind and sentence a company: the one of the smallest claim_id."""
    events = newest_pass(claims.where(F.startswith("kind", F.lit("now:"))))
    said = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    first = Window.partitionBy("ico", "kind", said).orderBy("claim_id")
    return events.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def dossiers(companies: DataFrame, claims: DataFrame) -> DataFrame:
    """ico and, nested: events, facts, inferences, discounted and discarded claims, each in order of claim_id.

    One aggregate by company; a company without claims has empty lists.
    """
    others = claims.where(~F.startswith("kind", F.lit("now:")))
    shown = usable(others).select("claim_id", F.lit(True).alias("__shown"))
    marked = others.join(shown, "claim_id", "left").withColumn(
        "part",
        F.when(F.col("state") == "discard", "discarded").when(F.col("__shown") & (F.col("state") == "fact"), "facts").when(F.col("__shown"), "inferences").when(~counts(), "discounted"),
    )
    rows = marked.where("part is not null").select("ico", "claim_id", "kind", "value", "quote", "part").unionByName(distinct_events(claims).select("ico", "claim_id", "kind", "value", "quote", F.lit("events").alias("part")))
    entry = F.struct("claim_id", "kind", "value", "quote")
    parts = ("events", "facts", "inferences", "discounted", "discarded")
    listed = rows.groupBy("ico").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, entry))).alias(p) for p in parts])
    empty = F.array().cast(listed.schema["facts"].dataType)
    return companies.select("ico", "name").join(listed, "ico", "left").select("ico", "name", *[F.coalesce(p, empty).alias(p) for p in parts])


def catalogue(week: DataFrame, documents: DataFrame, brief: dict[str, str]) -> DataFrame:
    """One JSON document: the brief, and the week's companies in order with what their dossiers hold. A week is a few rows by definition."""
    row = F.struct("place", "ico", "name", "reason", "class_slot", F.size("events").alias("events"), F.size("facts").alias("facts"), F.size("inferences").alias("inferences"))
    joined = week.select("ico", "place", "reason", "class_slot").join(documents, "ico", "left")
    listed = joined.agg(F.sort_array(F.collect_list(row)).alias("companies"), F.count("*").alias("n"))
    return listed.select(F.to_json(F.struct(_map(brief).alias("brief"), "n", "companies")).alias("document"))


def reading_order(week: DataFrame, richness: DataFrame, block: int = 100_000) -> DataFrame:
    """The week with ``reading``: by facts that aren't about the mode, most first, then by place.

    Places are unique.  Rows are counted for each number of facts and block of places and placed
    inside them, so no task sorts more than a block.
    """
    rows = week.join(richness.select("ico", "signal_facts"), "ico", "left")
    rows = rows.withColumn("__minus", -F.coalesce("signal_facts", F.lit(0))).withColumn("__block", F.floor(F.col("place") / block))
    groups = rows.groupBy("__minus", "__block").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__minus", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__minus", "__block").orderBy("place"))
    placed = rows.withColumn("__i", inside).join(starts, ["__minus", "__block"])
    return placed.withColumn("reading", (F.col("__start") + F.col("__i")).cast("int")).drop("__minus", "__block", "__start", "__i")


def complete(documents: DataFrame, sites: DataFrame, contacts: DataFrame, statements: DataFrame, certificates: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Dossiers (:func:`dossiers`) with website, contact, channels, turnover, certificates and vacancies, all nested.

    Each side is brought to one row a company first: ``sites`` (ico, domain, status), ``contacts``
    (:func:`contacts.company_contacts`), ``statements`` (:func:`turnover`), ``certificates``
    (:func:`certificates.company_certificates`), ``vacancies`` (ico, date, title).  A side that
    has nothing on a company leaves a null, or an empty list.
    """
    site = sites.groupBy("ico").agg(F.min(F.struct("domain", "status")).alias("website"))
    reach = contacts.select("ico", best_contact().alias("contact"), F.struct("emails", "personal_emails", "phones").alias("channels"))
    money = statements.groupBy("ico").agg(F.min(F.struct("status", "value_czk", "note", "state")).alias("turnover"))
    stated = certificates.where("standard is not null").groupBy("ico").agg(F.array_sort(F.collect_list(F.struct("standard", "number", "tier"))).alias("certificates"))
    posted = vacancies.groupBy("ico").agg(F.sort_array(F.collect_list(F.struct("date", "title")), asc=False).alias("vacancies"))
    rows = documents
    for side in (site, reach, money, stated, posted):
        rows = rows.join(side, "ico", "left")
    lists = {c: F.coalesce(c, F.array().cast(side.schema[c].dataType)) for c, side in (("certificates", stated), ("vacancies", posted))}
    return rows.withColumns(lists)


def delivery(week: DataFrame, documents: DataFrame) -> DataFrame:
    """place, ico and the line of the catalogue for each company of the week that somebody can be reached at.

    ``documents`` are complete dossiers; a company whose dossier names no contact has no line.
    """
    told = documents.where("contact is not null")
    line = F.struct("name", F.col("website.domain").alias("domain"), F.col("turnover.value_czk").alias("turnover_czk"), F.transform("certificates", lambda c: c["standard"]).alias("standards"), "contact", F.size("events").alias("events"), F.size("facts").alias("facts"), F.size("inferences").alias("inferences"))
    return week.select("ico", "place").join(told, "ico").select("place", "ico", line.alias("line"))
