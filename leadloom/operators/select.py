"""Selection: lexicographic order, delivery gate, group collapse, class quota, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.qualify import undeliverable
from leadloom.sources.store import materialize

#: The sort keys, best first; the company's key settles what is equal in all of them.
ORDERING = ("fit_rank", "demoted", "size_unknown", "class_rank", "not_corroborated", "not_preferred", "age_days", "minus_facts")
#: Divisions of the classification whose companies fit best, and next best (a parameter of the brief).
CORE, SERVICE = ("22", "25", "26", "27", "28", "29"), ("33", "46", "62")


def fit_rank(nace: Column, core: tuple[str, ...] = CORE, service: tuple[str, ...] = SERVICE) -> Column:
    division = F.substring(nace, 1, 2)
    return F.when(division.isin(*core), 0).when(division.isin(*service), 1).otherwise(2)


def evaluate(companies: DataFrame, reasons: DataFrame, richness: DataFrame | None = None, sites: DataFrame | None = None, limit_km: float = 150.0) -> DataFrame:
    """One row per gated company with all that the order and the gate need."""
    rows = companies.join(reasons, "ico")
    if richness is not None:
        rows = rows.join(richness.select("ico", "facts"), "ico", "left")
    else:
        rows = rows.withColumn("facts", F.lit(0))
    if sites is not None:
        rows = rows.drop("site_status", "has_channel").join(sites.select("ico", "site_status", "has_channel"), "ico", "left")
    preferred = F.when(F.col("km").isNotNull(), F.col("km") <= limit_km)
    return rows.select(
        "ico", "name", "reason", "families", "kinds", "has_tender",
        fit_rank(F.col("nace")).alias("fit_rank"),
        F.col("demoted").cast("int").alias("demoted"),
        (F.col("band") == "").cast("int").alias("size_unknown"),
        (F.ascii("reason") - F.lit(65)).alias("class_rank"),
        (~F.col("corroborated")).cast("int").alias("not_corroborated"),
        F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1).alias("not_preferred"),
        "age_days",
        (-F.coalesce("facts", F.lit(0))).cast("long").alias("minus_facts"),
        preferred.alias("preferred"),
        *[F.col(x) for x in ("site_status", "has_channel") if x in rows.columns],
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their place in the whole order.

    The place is counted in two steps, so that no task sorts all rows: rows are counted
    per combination of the coarse keys, and placed inside their combination.
    """
    rows = materialize(rows, "evaluated")
    coarse, fine = ORDERING[:6], ORDERING[6:]
    groups = rows.groupBy(*coarse).agg(F.count("*").alias("__n"))
    before = Window.orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*coarse).orderBy(*fine, "ico"))
    return rows.withColumn("__i", inside).join(F.broadcast(starts), list(coarse)).withColumn("place", (F.col("__start") + F.col("__i")).cast("int")).drop("__start", "__i")


def gate(rows: DataFrame) -> DataFrame:
    """Rows with ``problems``; deliverable are those without any."""
    return rows.withColumn("problems", undeliverable())


def held_back(rows: DataFrame) -> DataFrame:
    return gate(rows).select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def not_shown(rows: DataFrame, events: DataFrame, delivered: DataFrame) -> DataFrame:
    """Rows never delivered, or with an event later than the last delivery, or any tender."""
    last = delivered.groupBy("ico").agg(F.max("delivered_on").alias("last"))
    newest = events.groupBy("ico").agg(F.max("date").alias("newest"), F.bool_or(F.col("kind") == "tender_open").alias("tender"))
    joined = rows.join(last, "ico", "left").join(newest, "ico", "left")
    return joined.where(F.col("last").isNull() | F.coalesce("tender", F.lit(False)) | (F.col("newest") > F.col("last"))).select(*rows.columns)


def collapse(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per (owner, date): the best placed stays, with the others as ``siblings``.

    ``groups``: ico, owner, date of legal owners' events; a company's first group counts.
    A group's best is one aggregate, so tasks combine rows before the shuffle.
    """
    own = groups.groupBy("ico").agg(F.min(F.struct("owner", "date")).alias("g"))
    joined = rows.join(own, "ico", "left").withColumn("__alone", F.when(F.col("g").isNull(), F.col("ico")))
    kept = joined.groupBy("g", "__alone").agg(F.min(F.struct("place", *[x for x in rows.columns if x != "place"])).alias("b"), F.sort_array(F.collect_list("ico")).alias("all"))
    return kept.select(*[F.col(f"b.{x}").alias(x) for x in rows.columns], F.col("g.owner").alias("owner"), F.col("g.date").alias("owner_date"), F.array_remove("all", F.col("b.ico")).alias("siblings"))


def quota(rows: DataFrame, n: int) -> DataFrame:
    """The best of each class first, then by place; ``class_slot`` marks rows a plain top n lacks.

    Two bounded top lists are merged: the first of each class, and the first n of all.
    Pass ``rows`` that are written already, since both lists read them.
    """
    names = rows.columns
    firsts = rows.groupBy("reason").agg(F.min(F.struct("place", *[x for x in names if x not in ("place", "reason")])).alias("b"))
    firsts = firsts.select(*[F.col("reason") if x == "reason" else F.col(f"b.{x}").alias(x) for x in names])
    top = rows.orderBy("place").limit(n).withColumn("__top", F.lit(True))
    both = firsts.withColumn("__top", F.lit(False)).unionByName(top).groupBy("place").agg(
        F.bool_or("__top").alias("__top"), F.bool_or(~F.col("__top")).alias("__first"), F.first(F.struct(*names)).alias("b")
    )
    best = both.orderBy(F.col("__first").desc(), "place").limit(n)
    return best.select(*[F.col(f"b.{x}").alias(x) for x in names], (~F.col("__top")).alias("class_slot"))


def week(rows: DataFrame, events: DataFrame, delivered: DataFrame, groups: DataFrame, n: int = 5) -> DataFrame:
    """The whole selection: place, gate, history, collapse, quota -- in this order.

    ``rows`` are evaluated or already placed; what is read twice is written in between.
    """
    placed = rows if "place" in rows.columns else ranked(rows)
    fresh = not_shown(gate(placed).where(F.size("problems") == 0), events, delivered)
    return quota(materialize(collapse(fresh, groups), "collapsed"), n)


def newcomers(changes: DataFrame, companies: DataFrame, n: int = 25) -> DataFrame:
    """Companies to admit this time: those of known size first, then by key; the rest is counted."""
    fresh = materialize(changes.where("plan = 'new'").join(companies.select("ico", "band"), "ico").withColumn("unsized", F.when(F.col("band") == "", 1).otherwise(0)), "newcomers")
    return fresh.orderBy("unsized", "ico").limit(n).withColumn("deferred", F.lit(max(0, fresh.count() - n)))


def history(delivered: DataFrame, companies: DataFrame) -> DataFrame:
    """Deliveries with company names (null where unknown), and how often each was shown."""
    times = delivered.groupBy("ico").agg(F.count("*").alias("times"))
    rows = delivered.join(times, "ico").join(companies.select("ico", "name"), "ico", "left")
    return rows.withColumn("in_candidates", F.col("name").isNotNull())


def _padded(ico: str) -> Column:
    """A key of eight digits at least, as it was delivered otherwise: zeros and longer keys stay."""
    return F.when(F.length(ico) < 8, F.lpad(ico, 8, "0")).otherwise(F.col(ico))


def delivered_runs(delivered: DataFrame, companies: DataFrame) -> DataFrame:
    """One row a run: its companies by key, each with name (null where unknown) and how often it was shown in all runs.

    ``delivered``: ico, run_id, delivered_on.  A run is a week's list; what is counted is counted over all runs.
    """
    rows = history(delivered.withColumn("ico", _padded("ico")), companies)
    shown = F.array_sort(F.collect_list(F.struct("ico", "name", "in_candidates", "delivered_on", "times")))
    return rows.groupBy("run_id").agg(F.max("delivered_on").alias("delivered_on"), F.count("*").alias("n"), shown.alias("companies"))


def delivery_totals(delivered: DataFrame) -> DataFrame:
    """One row: runs, deliveries and companies delivered at least once."""
    rows = delivered.withColumn("ico", _padded("ico"))
    return rows.agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("deliveries"), F.count_distinct("ico").alias("companies"))


def mark_delivered(delivered: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows to append: (ico, run_id) pairs not there yet."""
    return fresh.dropDuplicates(["ico", "run_id"]).join(delivered.select("ico", "run_id"), ["ico", "run_id"], "left_anti")


def pool_counts(judged: DataFrame) -> DataFrame:
    """One row: all companies, those the brief rejects, of the others those excluded, and the pool that is left."""
    passed = F.col("reject_reason").isNull()
    out = F.col("verdict") == "exclude"
    return judged.agg(F.count("*").alias("total"), F.count_if(~passed).alias("rejected"), F.count_if(passed & out).alias("excluded"), F.count_if(passed & ~out).alias("pool"))


def contact_richness(people: DataFrame, channels: DataFrame) -> DataFrame:
    """ico, named_people, register_confirmed, any_channel from people with a channel and the companies' own channels.

    ``people``: ico, source, email, phone; ``channels``: ico of companies that print one.
    """
    reach = F.col("email").isNotNull() | F.col("phone").isNotNull()
    counted = people.groupBy("ico").agg(F.count_if(reach).alias("named_people"), F.count_if(reach & (F.col("source") == "register")).alias("register_confirmed"))
    own = channels.select("ico").distinct().withColumn("__own", F.lit(True))
    both = counted.join(own, "ico", "full").na.fill(0, ["named_people", "register_confirmed"])
    return both.select("ico", "named_people", "register_confirmed", ((F.col("named_people") > 0) | F.col("__own").isNotNull()).alias("any_channel"))


def vacancy_richness(vacancies: DataFrame) -> DataFrame:
    """ico, vacancies, vacancy_texts: postings, and those that say anything."""
    return vacancies.groupBy("ico").agg(F.count("*").alias("vacancies"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("vacancy_texts"))


def website_richness(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """ico, pages, mode_findings of proven sites; a site that isn't proven counts for nothing.

    ``documents``: ico, url, hits (what a page says of the mode).
    """
    found = documents.groupBy("ico").agg(F.count_distinct("url").alias("pages"), F.sum("hits").alias("mode_findings"))
    proven = F.col("status") == "proven"
    rows = sites.join(found, "ico", "left")
    return rows.select("ico", *[F.coalesce(F.when(proven, F.col(c)), F.lit(0)).cast("long").alias(c) for c in ("pages", "mode_findings")])


#: What each part of a company's material weighs.
WEIGHTS = {"facts": 6, "inferences": 2, "register_confirmed": 5, "mode_findings": 3, "named_people": 1, "pages": 1, "vacancy_texts": 1, "events": 1}


def richness_score(parts: DataFrame) -> DataFrame:
    """``parts`` (ico and any of the columns of WEIGHTS) with ``richness``; it is shown, not ranked by."""
    terms = [F.coalesce(F.col(c), F.lit(0)) * w for c, w in WEIGHTS.items() if c in parts.columns]
    return parts.withColumn("richness", sum(terms[1:], terms[0]).cast("long"))
