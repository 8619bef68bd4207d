"""Qualification: filters that name the criterion that rejects a company."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as X


@dataclass(frozen=True)
class Brief:
    """What is looked for; an empty criterion is off."""

    nace: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    origin: tuple[float, float] | None = None
    km: float | None = None
    tolerance_km: float = 5.0


def matches(brief: Brief, include_terminated: bool = False) -> Column:
    """The register predicate: alive, band, form and code prefix, each optional."""
    tests = [F.lit(True)]
    if not include_terminated:
        tests.append(F.col("ended").isNull())
    if brief.bands:
        tests.append(F.col("band").isin(*brief.bands))
    if brief.forms:
        tests.append(F.col("form").isin(*brief.forms))
    if brief.nace:
        tests.append(X.prefix_match("nace", brief.nace, "pass"))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def select_register(companies: DataFrame, brief: Brief) -> DataFrame:
    return companies.where(matches(brief))


def lookup(companies: DataFrame, keys: DataFrame, brief: Brief) -> DataFrame:
    """Wanted keys that match the brief; companies without a size band are admitted here."""
    sized = Brief(brief.nace, (), brief.forms, brief.regions)
    wanted = companies.join(keys.select("ico").distinct(), "ico", "left_semi").where(matches(sized))
    return wanted.where((F.col("band") == "") | F.col("band").isin(*brief.bands)) if brief.bands else wanted


def nearest_workplace(companies: DataFrame, sites: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Each company with km, place and site_km: nearest of seat and sites, and nearest site.

    Ties go to the seat, then to the sites in order; places without coordinates don't count.
    """
    lat, lon = (F.lit(v) for v in origin)
    seat = companies.select("ico", F.lit(0).alias("pos"), F.lit("seat").alias("place"), X.kilometres(lat, lon, F.col("lat"), F.col("lon")).alias("km"))
    other = sites.select("ico", (F.col("pos") + 1).alias("pos"), F.lit("site").alias("place"), X.kilometres(lat, lon, F.col("lat"), F.col("lon")).alias("km"))
    found = seat.unionByName(other).where("km is not null").groupBy("ico").agg(
        F.min(F.struct("km", "pos", "place")).alias("best"), F.min(F.when(F.col("place") == "site", F.col("km"))).alias("site_km")
    )
    return companies.join(found.select("ico", "best.km", "best.place", "site_km"), "ico", "left")


def reject_reason(brief: Brief) -> Column:
    """The first criterion that rejects, in fixed order, or null; needs ``km`` if a radius is set."""
    steps: list[Column] = []
    if brief.nace:
        steps.append(F.when(F.coalesce("nace", F.lit("")) == "", "nace_unknown").when(~X.prefix_match("nace", brief.nace, "fail"), "nace"))
    steps += [X.one_of("band", brief.bands, "size"), X.one_of("form", brief.forms, "legal_form"), X.one_of("region", brief.regions, "region")]
    if brief.km:
        steps.append(F.when(F.col("km").isNull(), "location_unknown").when(F.col("km") > brief.km + brief.tolerance_km, "outside_radius"))
    return F.coalesce(*steps)


def apply_brief(companies: DataFrame, sites: DataFrame, brief: Brief) -> DataFrame:
    """All companies with ``reject_reason`` (null: they pass)."""
    placed = nearest_workplace(companies, sites, brief.origin) if brief.km else companies
    return placed.withColumn("reject_reason", reject_reason(brief))


def funnel(judged: DataFrame) -> DataFrame:
    """Rows of reason and count; passing companies have the reason ``pass``."""
    return judged.groupBy(F.coalesce("reject_reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


def negative_findings() -> Column:
    """Array of level, reason, field, value; empty when nothing was found."""
    gone = F.coalesce(F.col("insolvent"), F.lit(False))
    closing = F.coalesce("name", F.lit("")).rlike(r"(?iU)\bv\s+likvidaci\b")
    closed = (F.col("sites_total") > 0) & (F.col("sites_active") == 0)

    def finding(test: Column, level: str, reason: str, field: str, value: Column) -> Column:
        return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"), F.lit(field).alias("field"), value.cast("string").alias("value")))

    found = F.array(
        finding(gone, "exclude", "insolvency", "insolvent", F.col("insolvent")),
        finding(closing, "exclude", "liquidation", "name", F.col("name")),
        finding(closed, "deprioritise", "all_sites_closed", "sites", F.concat_ws("/", "sites_active", "sites_total")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def verdict(findings: Column) -> Column:
    has = lambda level: F.exists(findings, lambda x: x["level"] == level)
    return F.when(has("exclude"), "exclude").when(has("deprioritise"), "deprioritise").otherwise("ok")


def with_verdict(companies: DataFrame, sites: DataFrame) -> DataFrame:
    """Companies with findings, verdict and demoted, from their sites' states."""
    counts = sites.groupBy("ico").agg(F.count("*").alias("sites_total"), F.count_if("active").alias("sites_active"))
    judged = companies.join(counts, "ico", "left").withColumn("findings", negative_findings())
    judged = judged.withColumn("verdict", verdict(F.col("findings")))
    return judged.withColumn("demoted", F.exists("findings", lambda x: x["level"] == "deprioritise"))


def eligible(judged: DataFrame) -> DataFrame:
    """Companies that pass the brief and aren't excluded; ``judged`` has reject_reason and verdict."""
    return judged.where("reject_reason is null and verdict <> 'exclude'")


def undeliverable() -> Column:
    """Array of what blocks delivery: a site that isn't proven, no channel."""
    problems = F.array(
        F.when(F.coalesce("site_status", F.lit("")) != "proven", "site_unproven"),
        F.when(~F.coalesce("has_channel", F.lit(False)), "no_channel"),
    )
    return F.filter(problems, lambda x: x.isNotNull())


def code_names(rows: DataFrame, codes: DataFrame, code_col: str, levels: Sequence[int] = (5, 4, 3, 2)) -> DataFrame:
    """Rows with ``code_name``: the name of the code, or of its longest known beginning."""
    own = [F.struct(F.lit(i).alias("rank"), F.substring(code_col, 1, n).alias("code")) for i, n in enumerate(levels)]
    asked = rows.select(code_col).distinct().select(code_col, F.inline(F.array(*own)))
    best = asked.join(codes.select("code", "text"), "code").groupBy(code_col).agg(F.min_by("text", "rank").alias("code_name"))
    return rows.join(best, code_col, "left")


def baseline(companies: DataFrame, forms: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """Companies alive and of a wanted form, with ``code``: the first of ``codes`` that isn't blank."""
    code = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in codes], F.lit(""))
    return companies.where(F.col("ended").isNull() & F.col("form").isin(*forms)).withColumn("code", code)


def with_label(rows: DataFrame, column: str, names: dict[str, str], label: str) -> DataFrame:
    """Rows with the name of a code; a code without one stands for itself."""
    return rows.withColumn(label, F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col(column)], F.col(column)))


def admit(base: DataFrame, register: DataFrame, newcomers: DataFrame) -> DataFrame:
    """The base and the register's rows of companies that are new to it; both have the base's columns."""
    return base.unionByName(register.join(newcomers.select("ico").distinct(), "ico", "left_semi").select(*base.columns))


def summary(rows: DataFrame) -> DataFrame:
    """The columns of a register row that a reader is shown."""
    return rows.select("ico", "name", F.col("band").alias("size"), "nace", "form", "district", "city")
