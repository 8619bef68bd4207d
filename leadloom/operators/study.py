"""Measurements behind the windows: lags, back-tests, sweeps, seasons and ages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _age(day: str | Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col(day) if isinstance(day, str) else day)


def rank_percentile(rows: DataFrame, day: str, as_of: str, share: float = 0.01) -> DataFrame:
    """The age at rank floor(n * share), exactly: ages are counted, not sorted.

    Distinct ages are few (days), so a running sum over their counts finds the rank.
    """
    ages = rows.select(_age(day, as_of).alias("age")).where("age is not null").groupBy("age").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy("age"))
    placed = ages.select("age", total.alias("total"), upto.alias("upto"))
    return placed.where(F.col("upto") > F.floor(F.col("total") * share)).agg(F.min("age").alias("lag"), F.max("total").alias("n"))


def source_lags(sources: dict[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """Per source: newest day, its age and rows."""
    out: DataFrame | None = None
    for name, (rows, day) in sources.items():
        one = rows.agg(F.max(day).cast("date").alias("newest"), F.count(day).alias("n")).select(F.lit(name).alias("source"), "newest", _age("newest", as_of).alias("age_days"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def window_sweep(events: DataFrame, widths: Sequence[int], as_of: str) -> DataFrame:
    """Companies per family and window width; ``any`` counts a company once.

    Each event falls into all windows from its age on: it is written once per width that
    holds it, and a company's youngest event per family stands for all of them.
    """
    young = events.withColumn("age", _age("date", as_of)).where("age >= 0").groupBy("ico", "family").agg(F.min("age").alias("age"))
    both = young.unionByName(young.groupBy("ico").agg(F.min("age").alias("age")).withColumn("family", F.lit("any")))
    wide = both.select("family", F.explode(F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: w >= F.col("age"))).alias("width"))
    return wide.groupBy("width", "family").agg(F.count("*").alias("companies"))


def weekly(events: DataFrame, as_of: str, weeks: int, deliverable: DataFrame | None = None) -> DataFrame:
    """Per week back from ``as_of``: companies with an event, and of them deliverable; zeros stay."""
    spark = events.sparkSession
    rows = events.withColumn("age", _age("date", as_of)).where(f"age >= 0 and age < {7 * weeks}").select("ico", F.floor(F.col("age") / 7).cast("int").alias("week")).distinct()
    if deliverable is not None:
        rows = rows.join(deliverable.select("ico").withColumn("ok", F.lit(True)), "ico", "left")
    else:
        rows = rows.withColumn("ok", F.lit(True))
    counts = rows.groupBy("week").agg(F.count("*").alias("companies"), F.count_if("ok").alias("deliverable"))
    return calendar(spark, weeks).join(counts, "week", "left").na.fill(0, ["companies", "deliverable"])


def calendar(spark: SparkSession, weeks: int) -> DataFrame:
    return spark.range(weeks).select(F.col("id").cast("int").alias("week"))


def weekly_summary(weeks: DataFrame, floor: int = 5) -> DataFrame:
    return weeks.agg(
        F.percentile("companies", F.lit(0.5)).alias("median"), F.avg("companies").alias("mean"), F.min("companies").alias("least"), F.max("companies").alias("most"),
        F.count_if(F.col("companies") >= floor).alias("enough"), F.count("*").alias("weeks"),
    )


def seasonality(weeks: DataFrame, as_of: str) -> DataFrame:
    """month, per_week: companies with an event per week, over all weeks of a calendar month, those without any too.

    ``weeks`` is what :func:`weekly` gives; a week belongs to the month of its last day.
    """
    day = F.date_sub(F.lit(as_of).cast("date"), F.col("week") * 7)
    return weeks.groupBy(F.month(day).alias("month")).agg(F.avg("companies").alias("per_week"))


def age_profile(events: DataFrame, as_of: str) -> DataFrame:
    """Per family: youngest, upper median (rank n // 2) and oldest age."""
    ages = events.withColumn("age", _age("date", as_of)).groupBy("family", "age").agg(F.count("*").alias("n"))
    own = Window.partitionBy("family")
    placed = ages.select("family", "age", F.sum("n").over(own).alias("total"), F.sum("n").over(own.orderBy("age")).alias("upto"))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("age")))
    return placed.groupBy("family").agg(F.min("age").alias("youngest"), middle.alias("upper_median"), F.max("age").alias("oldest"))


def age_histogram(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Events of each age from 0 to ``days``, zeros included."""
    counts = events.select(_age("date", as_of).alias("age")).where(f"age between 0 and {days}").groupBy("age").agg(F.count("*").alias("n"))
    every = events.sparkSession.range(days + 1).select(F.col("id").cast("int").alias("age"))
    return every.join(counts, "age", "left").na.fill(0, ["n"])


def kind_shares(events: DataFrame) -> DataFrame:
    counts = events.groupBy("kind").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def owner_shares(events: DataFrame) -> DataFrame:
    """One row: ownership events, those whose owner is a company, and their share (null without any).

    ``events``: kind, legal_entity.
    """
    own = F.startswith("kind", F.lit("owner_"))
    n, legal = F.count_if(own), F.count_if(own & F.coalesce("legal_entity", F.lit(False)))
    return events.agg(n.alias("owner_events"), legal.alias("legal_entities"), F.when(n > 0, legal / n).alias("share"))


def familiar_arrivals(events: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: directors who arrive, those whom the company's record knows in another place, and their share.

    ``events``: ico, kind, name; ``entries``: ico, role (director, owner), name, departed.  Owners,
    departed owners and departed directors count as known; a sitting director is the arrival itself.
    Names are compared in lower case, a missing one as an empty one.
    """
    key = F.lower(F.coalesce("name", F.lit(""))).alias("key")
    known = entries.where("role = 'owner' or departed").select("ico", key).distinct().withColumn("known", F.lit(True))
    arrivals = events.where("kind = 'director_joined'").groupBy("ico", key).agg(F.count("*").alias("n"))
    n, familiar = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return arrivals.join(known, ["ico", "key"], "left").agg(n.alias("arrivals"), familiar.alias("familiar"), F.when(n > 0, familiar / n).alias("share"))


def coverage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows with a value, per column."""
    known = rows.agg(*[F.avg(F.nullif(F.col(x).cast("string"), F.lit("")).isNotNull().cast("int")).alias(x) for x in columns])
    return known.select(F.inline(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("share")) for x in columns])))


def base_rate(companies: DataFrame, hits: DataFrame, known: Column) -> DataFrame:
    """Companies, hits and rate where an attribute is known and where it isn't; ``hits`` may repeat a company."""
    found = hits.select("ico").distinct().withColumn("hit", F.lit(True))
    rows = companies.withColumn("known", known).join(found, "ico", "left")
    return rows.groupBy("known").agg(F.count("*").alias("companies"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").isNotNull().cast("int")).alias("rate"))


#: People taken for the middle of a headcount band (fixed values).
MIDPOINT = {"220": 22, "230": 37, "240": 75, "310": 150, "330": 375, "340": 750, "410": 1250, "210": 15, "130": 8, "120": 3}


def vacancy_ceiling(vacancies: DataFrame, companies: DataFrame, groups: Sequence[str], widths: Sequence[int], as_of: str) -> DataFrame:
    """Per window: companies with any vacancy, three or more, a tenth of their headcount or more, and a management post.

    ``vacancies``: ico, date, occupation; ``companies``: ico, band.  Vacancies of each company are
    counted per age band first; a company without a midpoint reaches no tenth.
    """
    steps = sorted(widths)
    first = F.get(F.filter(F.array(*map(F.lit, steps)), lambda w: w >= F.col("age")), 0)
    rows = vacancies.withColumn("age", _age("date", as_of)).where("age >= 0").withColumn("step", first).where("step is not null")
    counted = rows.groupBy("ico", "step").agg(F.count("*").alias("n"), F.count_if(F.col("occupation").isin(*groups)).alias("m"))
    wide = counted.select("ico", "n", "m", F.explode(F.filter(F.array(*map(F.lit, steps)), lambda w: w >= F.col("step"))).alias("width"))
    each = wide.groupBy("width", "ico").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    middle = F.create_map(*[F.lit(x) for p in MIDPOINT.items() for x in p])
    rows = each.join(companies.select("ico", F.try_element_at(middle, F.coalesce("band", F.lit(""))).alias("heads")), "ico")
    return rows.groupBy("width").agg(
        F.count("*").alias("any_vacancy"), F.count_if(F.col("n") >= 3).alias("three_plus"),
        F.count_if(F.col("n") * 10 >= F.col("heads")).alias("tenth"), F.count_if(F.col("m") > 0).alias("management"),
    )


def feed_overlap(feeds: dict[str, DataFrame], base: DataFrame) -> DataFrame:
    """Per feed: its rows and how many companies of the base it names."""
    rows: DataFrame | None = None
    for name, feed in feeds.items():
        one = feed.groupBy("ico").agg(F.count("*").alias("n")).withColumn("feed", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    ours = rows.join(base.select("ico").distinct().withColumn("ours", F.lit(True)), "ico", "left")
    return ours.groupBy("feed").agg(F.sum("n").alias("n"), F.count_if("ours").alias("companies"))


def register_dates(people: DataFrame) -> DataFrame:
    """ico, date, kind, name: each entry's arrival, and its departure where it has one.

    ``people``: ico, role (director, owner), name, since, until; both present and departed
    entries, since a departed one arrived too.  An entry without a date gives nothing.
    """
    days = F.array(F.struct(F.col("since").alias("date"), F.lit("joined").alias("what")), F.struct(F.col("until").alias("date"), F.lit("departed").alias("what")))
    rows = people.select("ico", "role", F.lower("name").alias("name"), F.inline(days)).where("date is not null")
    return rows.select("ico", "date", F.concat_ws("_", "role", "what").alias("kind"), "name")
