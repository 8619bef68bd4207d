"""Dated signals: a window per source, rules against bookkeeping noise, reason classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text as X

#: Signal family of each kind of event (fixed values).
FAMILIES = {
    "subsidy_signed": "subsidy", "director_joined": "registry", "director_departed": "registry", "owner_joined": "registry",
    "owner_departed": "registry", "tender_open": "tender", "management_vacancy": "growth",
}
#: Family that makes each reason class, days of a founding and of a re-entry (fixed values).
CLASS_FAMILIES = {"A": "subsidy", "B": "registry", "C": "tender", "D": "growth"}
FOUNDING_DAYS, REENTRY_DAYS = 400, 3


def in_window(day: Column, as_of: str, days: int) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), day)
    return (age >= 0) & (age <= days)


def family_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(table[kind], F.lit("other"))


def mass_guarded(moves: DataFrame, companies: DataFrame) -> DataFrame:
    """Moves without lists that only record an entry of everybody at once.

    A list is a company's moves of one kind, before any window.  Several people all on
    one date: dropped; a single date within 400 days after the founding: dropped.
    """
    own = Window.partitionBy("ico", "kind")
    lists = moves.select("*", F.count("*").over(own).alias("__people"), F.min("date").over(own).alias("__only"), F.max("date").over(own).alias("__last"))
    joined = lists.join(companies.select("ico", F.col("founded").alias("__founded")), "ico", "left")
    one_day = F.coalesce(F.col("__only") == F.col("__last"), F.lit(False))
    early = F.coalesce(F.datediff("__only", "__founded") < FOUNDING_DAYS, F.lit(False))
    return joined.where(~(one_day & ((F.col("__people") > 1) | early))).select(*moves.columns)


def registry_events(moves: DataFrame, companies: DataFrame, as_of: str, window: int) -> DataFrame:
    return mass_guarded(moves, companies).where(in_window(F.col("date"), as_of, window))


def drop_reentries(events: DataFrame, current: DataFrame | None = None, days: int = REENTRY_DAYS) -> DataFrame:
    """Events without arrival/departure pairs of one person within ``days``.

    All events of a paired (name, date) of the company go, whatever their role.  Then
    departures go of people who are still listed in that role (``current``: ico, role,
    name).  One sort by company and name serves both frames; nothing is joined with itself.
    """
    person = Window.partitionBy("ico", "name").orderBy("__day")
    arrived, left = F.endswith("kind", F.lit("_joined")), F.endswith("kind", F.lit("_departed"))
    near = lambda what: F.count_if(what).over(person.rangeBetween(-days, days)) > 0
    rows = events.withColumn("__day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    rows = rows.withColumn("__paired", ((arrived & near(left)) | (left & near(arrived))) & F.col("name").isNotNull() & F.col("date").isNotNull())
    rows = rows.withColumn("__gone", F.bool_or("__paired").over(person.rangeBetween(0, 0))).where("not __gone")
    if current is None:
        return rows.select(*events.columns)
    listed = current.select("ico", F.col("role").alias("__role"), F.lower("name").alias("__low")).distinct().withColumn("__listed", F.lit(True))
    rows = rows.withColumn("__role", F.split("kind", "_")[0]).withColumn("__low", F.lower("name")).join(listed, ["ico", "__role", "__low"], "left")
    return rows.where(~(left & F.col("__listed").isNotNull())).select(*events.columns)


def vacancy_record(history: DataFrame, current: DataFrame, floor: str) -> DataFrame:
    """History and current postings, one per (ico, date, group); the history's row wins."""
    rows = history.withColumn("origin", F.lit(0)).unionByName(current.withColumn("origin", F.lit(1)))
    rows = rows.withColumn("occupation", X.occupation_group("isco")).where(F.col("date") >= F.lit(floor).cast("date"))
    best = rows.groupBy("ico", "date", "occupation").agg(F.min(F.struct("origin", "title")).alias("b"))
    return best.select("ico", "date", "occupation", "b.title", "b.origin")


def confidence(months: str) -> Column:
    return F.when(F.col(months) >= 12, "high").when(F.col(months) >= 6, "low")


def observation_depth(record: DataFrame) -> DataFrame:
    """months observed per company and the confidence that gives (null: too few)."""
    months = record.groupBy("ico").agg(F.count_distinct(F.trunc("date", "month")).alias("months"))
    return months.withColumn("confidence", confidence("months"))


def vacancy_events(record: DataFrame, groups: Sequence[str], as_of: str, window: int) -> DataFrame:
    """Postings of the wanted groups in the window, of companies observed long enough."""
    months = F.size(F.collect_set(F.trunc("date", "month")).over(Window.partitionBy("ico"))).cast("long")
    seen = record.withColumn("months", months).where(F.col("occupation").isin(*groups) & in_window(F.col("date"), as_of, window))
    return seen.withColumn("confidence", confidence("months")).where("confidence is not null")


def tender_events(tenders: DataFrame, as_of: str) -> DataFrame:
    """Relevant open tenders with a deadline today or later; without a deadline none is open."""
    left = F.datediff("deadline", F.lit(as_of).cast("date"))
    return tenders.where(F.col("relevant") & (F.col("status") == "open") & (left >= 0)).withColumn("days_left", left).withColumn("age_days", F.lit(0))


def feed_lag(rows: DataFrame, day: str, as_of: str) -> DataFrame:
    """One row: days between ``as_of`` and the newest record."""
    return rows.agg(F.datediff(F.lit(as_of).cast("date"), F.max(day)).alias("lag"))


def project_kind(rules: Sequence[tuple[str, str]]) -> Column:
    """Class of a project: the first rule reads title and description, all others the title."""
    first, *rest = rules
    both = X.fold(F.concat_ws(" ", "project", "description"))
    return F.when(both.rlike(first[1]), first[0]).otherwise(X.classify(X.fold("project"), rest))


def funding_events(subsidies: DataFrame, rules: Sequence[tuple[str, str]], signal: Sequence[str], live: Sequence[str], as_of: str, window: int = 120, slack: int = 30) -> DataFrame:
    """Live subsidies in the window, with the project's class; fresh ones within lag + slack days.

    Only the first rule reads the description too; all others see the title alone.
    """
    kind = project_kind(rules)
    lag = feed_lag(subsidies, "signed", as_of).scalar()
    age = F.datediff(F.lit(as_of).cast("date"), "signed")
    rows = subsidies.where(F.col("state").isin(*live) & in_window(F.col("signed"), as_of, window))
    rows = rows.withColumn("project_kind", kind).where(F.col("project_kind").isin(*signal)).withColumn("age_days", age)
    return rows.withColumn("fresh", F.col("age_days") <= lag + slack)


def reasons(events: DataFrame, tenders: DataFrame) -> DataFrame:
    """Per company: reason class A to E, families, kinds, corroborated, age of the deciding event.

    ``events``: ico, kind, age_days.  A subsidy counts as class A only where the company
    has no relevant tender.
    """
    fam = events.withColumn("family", family_of(F.col("kind")))
    ages = [F.min(F.when(F.col("family") == f, F.col("age_days"))).alias(f"age_{f}") for f in CLASS_FAMILIES.values()]
    view = fam.groupBy("ico").agg(
        F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("age_days").alias("youngest"), *ages
    )
    has = tenders.where("relevant").select("ico").distinct().withColumn("has_tender", F.lit(True))
    view = view.join(has, "ico", "left").withColumn("has_tender", F.coalesce("has_tender", F.lit(False)))
    holds = lambda f: F.array_contains("families", f)
    letter = F.when(holds("subsidy") & ~F.col("has_tender"), "A").when(holds("registry"), "B").when(holds("tender"), "C").when(holds("growth"), "D").otherwise("E")
    view = view.withColumn("reason", letter).withColumn("corroborated", F.size("kinds") >= 2)
    own = F.coalesce(*[F.when(F.col("reason") == k, F.col(f"age_{f}")) for k, f in CLASS_FAMILIES.items()], "youngest", F.lit(1_000_000))
    return view.select("ico", "reason", "families", "kinds", "corroborated", "has_tender", own.alias("age_days"))


# Codes and words of what is tendered.
RELEVANT_CODES = ("48", "72", "42961")
SUBJECT = (
    r"(?i)\bERP\b|\bMES\b|\bWMS\b|\bAPS\b|informa[cč]n[ií]\s*syst[ée]m|[rř][ií]zen[ií]\s*v[ýy]roby|pl[aá]nov[aá]n[ií]\s*v[ýy]roby|"
    r"v[ýy]robn[ií]\s*syst[ée]m|termin[aá]l|[cč]árov[ée]\s*k[oó]dy|sb[eě]r\s*dat|dispe[cč]|sklado[vw]"
)


def with_relevance(tenders: DataFrame, codes: Sequence[str] = RELEVANT_CODES, subject: str = SUBJECT) -> DataFrame:
    """Tenders with ``relevant``: by the beginning of their code, or by what their name says."""
    by_code = F.coalesce(F.col("cpv").rlike("^(" + "|".join(codes) + ")"), F.lit(False))
    return tenders.withColumn("relevant", by_code | F.coalesce(F.col("name").rlike(subject), F.lit(False)))


def already_buying(subsidies: DataFrame, rules: Sequence[tuple[str, str]], kind: str = "already_buying") -> DataFrame:
    """ico, project: distinct projects whose title alone says that a system is being bought."""
    return subsidies.where(X.classify(X.fold("project"), rules) == kind).select("ico", "project").distinct()


def vacancy_texts(vacancies: DataFrame) -> DataFrame:
    """ico, label, text: title and body of each posting as one text; postings without any are left out."""
    blank = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    rows = vacancies.select("ico", F.coalesce(blank("title"), F.col("id").cast("string")).alias("label"), F.concat_ws(" ", blank("title"), blank("text")).alias("text"))
    return rows.where("text <> ''")


def kinds_per_window(events: DataFrame, widths: Sequence[int], as_of: str) -> DataFrame:
    """width, kind, n: events of each kind not older than each width; an event is counted in all windows that hold it."""
    aged = events.select("kind", F.datediff(F.lit(as_of).cast("date"), "date").alias("age")).where("age >= 0").groupBy("kind", "age").agg(F.count("*").alias("m"))
    wide = aged.select("kind", "m", F.explode(F.filter(F.array(*map(F.lit, widths)), lambda w: w >= F.col("age"))).alias("width"))
    return wide.groupBy("width", "kind").agg(F.sum("m").alias("n"))


def depth_cost(record: DataFrame, groups: Sequence[str], widths: Sequence[int], as_of: str) -> DataFrame:
    """width, companies, observed: companies with a wanted posting in a window, and those watched long enough to tell."""
    months = F.size(F.collect_set(F.trunc("date", "month")).over(Window.partitionBy("ico")))
    young = record.withColumn("months", months).where(F.col("occupation").isin(*groups)).withColumn("age", F.datediff(F.lit(as_of).cast("date"), "date")).where("age >= 0")
    each = young.groupBy("ico").agg(F.min("age").alias("age"), F.max("months").alias("months"))
    wide = each.select("months", F.explode(F.filter(F.array(*map(F.lit, widths)), lambda w: w >= F.col("age"))).alias("width"))
    return wide.groupBy("width").agg(F.count("*").alias("companies"), F.count_if(confidence("months").isNotNull()).alias("observed"))


def already_known(moves: DataFrame) -> DataFrame:
    """Arrivals of directors whose name is elsewhere in the company's own record: as an owner, or as one who left."""
    own = Window.partitionBy("ico", F.lower("name"))
    director = F.col("kind") == "director_joined"
    return moves.withColumn("__else", F.count_if(~director).over(own)).where(director & (F.col("__else") > 0) & F.col("name").isNotNull()).drop("__else")


def by_age(events: DataFrame, as_of: str) -> DataFrame:
    """Events with ``age_days`` and their ``place`` in the company's list, the youngest first, then by kind and name.

    ``events``: ico, date, kind, name and others; an event without a date comes last.
    """
    aged = events.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), "date"))
    order = Window.partitionBy("ico").orderBy(F.asc_nulls_last("age_days"), "kind", "name")
    return aged.withColumn("place", F.row_number().over(order))
