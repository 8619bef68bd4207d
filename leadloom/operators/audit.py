"""Audit: each check is a DataFrame of violations and must be empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.select import ORDERING

#: Places that one task compares in the check of the order.
BLOCK = 100_000

CHECKS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def check(name: str):
    """Register a check: a function from the tables by name to a table with ``ico`` of violations."""

    def keep(function: Callable[[dict[str, DataFrame]], DataFrame]):
        CHECKS[name] = function
        return function

    return keep


@check("brief")
def satisfies_brief(t):
    return t["ranked"].join(t["judged"].where("reject_reason is not null"), "ico", "left_semi").select("ico")


@check("excluded")
def not_excluded(t):
    return t["ranked"].join(t["judged"].where("verdict = 'exclude'"), "ico", "left_semi").select("ico")


@check("event")
def has_event(t):
    return t["ranked"].join(t["events"].select("ico").distinct(), "ico", "left_anti").select("ico")


@check("site")
def proven_site(t):
    return t["week"].where("coalesce(site_status, '') <> 'proven'").select("ico")


@check("channel")
def channel(t):
    return t["week"].where("not coalesce(has_channel, false)").select("ico")


@check("monotone")
def monotone(t):
    rows = t["ranked"].select("ico", "place", F.struct(*ORDERING, "ico").alias("k"), F.floor((F.col("place") - 1) / BLOCK).alias("block"))
    within = rows.withColumn("b", F.lag("k").over(Window.partitionBy("block").orderBy("place"))).where("b > k").select("ico")
    # Blocks that hold no row leave no gap: each block's first row meets the last one of the block before it.
    edges = rows.groupBy("block").agg(F.min(F.struct("place", "k")).alias("first"), F.max(F.struct("place", "k")).alias("last"))
    across = edges.withColumn("b", F.lag("last.k").over(Window.orderBy("block"))).where("b > first.k").select("first.k.ico")
    return within.unionByName(across)


@check("class")
def class_recomputes(t):
    return t["ranked"].join(t["reasons"].select("ico", F.col("reason").alias("again")), "ico").where("reason <> again").select("ico")


@check("groups")
def one_per_group(t):
    return t["week"].where("owner is not null").groupBy("owner", "owner_date").agg(F.count("*").alias("n"), F.min("ico").alias("ico")).where("n > 1").select("ico")


@check("distinct")
def distinct_companies(t):
    return t["week"].groupBy("ico").agg(F.count("*").alias("n")).where("n > 1").select("ico")


@check("radius")
def inside_radius(t):
    """Needs the brief's ``km`` and the companies' distances in ``week``; without a radius nothing is outside."""
    if t.get("km") is None:
        return t["week"].where("false").select("ico")
    return t["week"].where(F.col("km").isNull() | (F.col("km") > t["km"] + 5.0)).select("ico")


@check("buying")
def not_already_buying(t):
    """Nobody is on the list for a subsidy who holds one whose project names a system already."""
    funded = t["week"].join(t["events"].where("kind = 'subsidy_signed'"), "ico", "left_semi")
    return funded.join(t["buying"], "ico", "left_semi").select("ico")


@check("reasons_known")
def held_back_explained(t):
    """A ranked row is held back for known reasons only."""
    known = F.array(F.lit("site_unproven"), F.lit("no_channel"))
    return t["gated"].where(F.size(F.array_except("problems", known)) > 0).select("ico")


@check("values")
def known_values(t):
    """Claims of unknown state or relevance, and companies delivered twice in one run."""
    odd = t["claims"].where(~F.col("state").isin("fact", "inference", "discard") | ~F.coalesce(F.col("relevance").isin("supports", "unrelated"), F.lit(True))).select("ico")
    twice = t["delivered"].groupBy("ico", "run_id").agg(F.count("*").alias("n")).where("n > 1").select("ico")
    return odd.unionByName(twice)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """check, violations: one row per check, all zero when the run is sound."""
    out: DataFrame | None = None
    for name, function in CHECKS.items():
        one = function(tables).agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def dangling(claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Claims whose snapshot isn't stored."""
    return claims.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")
