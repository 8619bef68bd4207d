"""Facet counts of the register, place suggestions, change plans and identity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(companies: DataFrame) -> DataFrame:
    """facet, value, n over code, band and district in one scan."""
    rows = companies.groupingSets([["nace"], ["band"], ["district"]], "nace", "band", "district").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "nace").when(F.col("g") == 5, "band").otherwise("district")
    value = F.when(F.col("g") == 3, F.col("nace")).when(F.col("g") == 5, F.col("band")).otherwise(F.col("district"))
    return rows.select(facet.alias("facet"), value.alias("value"), "n")


def code_rollup(companies: DataFrame) -> DataFrame:
    """division, code, n: totals of divisions (null code) and of codes; empty codes are left out.

    ``bare`` marks a code that is only its division.
    """
    rows = companies.where("nace <> ''").withColumn("division", F.substring("nace", 1, 2)).withColumnRenamed("nace", "code")
    counts = rows.rollup("division", "code").agg(F.count("*").alias("n")).where("division is not null")
    return counts.withColumn("bare", F.coalesce(F.col("code") == F.col("division"), F.lit(False)))


def region_counts(companies: DataFrame) -> DataFrame:
    return companies.where("district <> ''").groupBy(F.substring("district", 1, 5).alias("region_code")).agg(F.count("*").alias("n"))


def band_counts(companies: DataFrame, bands: DataFrame) -> DataFrame:
    """Every band of the codebook in its order, with zero where no company has it."""
    counts = companies.groupBy("band").agg(F.count("*").alias("n"))
    return bands.join(counts, "band", "left").select("pos", "band", F.coalesce("n", F.lit(0)).alias("n"))


def suggest(places: DataFrame, typed: str, n: int = 6) -> DataFrame:
    """Places whose name is the typed text, begins with it or contains it; shorter ones first."""
    low, want = F.lower("name"), F.lit(typed.lower())
    grade = F.when(low == want, 0).when(F.startswith(low, want), 1).when(F.contains(low, want), 2)
    return places.withColumn("grade", grade).where("grade is not null").orderBy("grade", F.length("name"), "name").limit(n)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each company over all batches."""
    return changes.groupBy("ico").agg(F.max_by("kind", F.struct("batch", "pos")).alias("kind"))


def change_plan(changes: DataFrame, base: DataFrame) -> DataFrame:
    """What each changed company asks for: new, gone or refresh."""
    known = base.select("ico").withColumn("known", F.lit(True))
    plan = F.when(F.col("known").isNull(), "new").when(F.col("kind") == "DEL", "gone").otherwise("refresh")
    return latest_changes(changes).join(known, "ico", "left").select("ico", "kind", plan.alias("plan"))


def contested(sites: DataFrame, weak: tuple[str, ...] = ("person", "address", "name_city", "name")) -> DataFrame:
    """Sites with ``holders``; a proven domain of two or more weak holders is only probable."""
    is_weak = F.col("evidence").isin(*weak) & (F.col("status") == "proven")
    holders = sites.where(is_weak).groupBy("domain").agg(F.count("*").alias("holders"))
    rows = sites.join(holders, "domain", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    return rows.withColumn("status", F.when(is_weak & (F.col("holders") >= 2), "probable").otherwise(F.col("status")))


def same_answers(rows: DataFrame, answer: str, least: int = 2) -> DataFrame:
    """Answers that several companies share."""
    return rows.groupBy(answer).agg(F.count_distinct("ico").alias("companies")).where(F.col("companies") >= least)


def status_tally(rows: DataFrame, status: str) -> DataFrame:
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def selection_state(facets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per division: companies behind the chosen codes, and whether all, some or none are chosen."""
    rows = facets.join(chosen.select("code").distinct().withColumn("on", F.lit(True)), "code", "left")
    picked = F.count_if("on")
    state = F.when(picked == F.count("*"), "on").when(picked > 0, "some").otherwise("off")
    return rows.groupBy("division").agg(F.coalesce(F.sum(F.when(F.col("on"), F.col("n"))), F.lit(0)).alias("companies"), state.alias("state"))


def centroid(outlines: DataFrame) -> DataFrame:
    """Mean of all points of a place's rings (array of arrays of lon/lat), to five decimals."""
    points = outlines.select("code", F.explode(F.flatten("rings")).alias("p"))
    return points.groupBy("code").agg(F.bround(F.avg(F.col("p")[0]), 5).alias("lon"), F.bround(F.avg(F.col("p")[1]), 5).alias("lat"))


def ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model: calls, tokens and cost by a price list per million tokens."""
    priced = calls.join(F.broadcast(prices), "model")
    cost: Column = F.round((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000, 6)
    return priced.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cost).alias("cost"))


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with its ``cost``, to six decimals; null where the list has no price for its model and mode.

    ``calls``: model, mode, cached, tokens_in, tokens_out and others; ``prices``: model, mode, price_in,
    price_out, price_cached (null: cached input costs what other input costs), per million tokens.
    """
    priced = calls.join(prices.select("model", "mode", "price_in", "price_out", "price_cached"), ["model", "mode"], "left")
    rate = F.coalesce(F.when(F.col("cached"), F.col("price_cached")), "price_in")
    cost = F.round((F.coalesce("tokens_in", F.lit(0)) * rate + F.coalesce("tokens_out", F.lit(0)) * F.col("price_out")) / 1_000_000, 6)
    return priced.select(*calls.columns, cost.alias("cost"))


def spent(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, those without a price, tokens and cost to four decimals, of all or by columns of :func:`call_costs`."""
    return costs.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"),
    )


def company_index(companies: DataFrame, places: DataFrame) -> DataFrame:
    """One row a company for the map: the last row of a key stands, with its division and its town's point.

    ``companies``: ico, pos, code, place and others; ``places``: place, lat, lon, one row a place.
    A company of an unknown place keeps null coordinates.  Write it partitioned by ``division``.
    """
    rest = [x for x in companies.columns if x not in ("ico", "pos")]
    last = companies.groupBy("ico").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("ico", "r.*")
    return last.withColumn("division", F.substring("code", 1, 2)).join(places.select("place", "lat", "lon"), "place", "left")


def division_documents(companies: DataFrame) -> DataFrame:
    """One nested row a division: its total and its codes, the largest first, of equal ones by code.

    A code that is only its division is in the total and ``bare``, not among the codes.
    """
    counts = companies.where("nace <> ''").groupBy(F.substring("nace", 1, 2).alias("division"), "nace").agg(F.count("*").alias("n"))
    bare = F.col("nace") == F.col("division")
    codes = F.array_sort(F.collect_list(F.when(~bare, F.struct((-F.col("n")).alias("o"), F.col("nace").alias("code")))))
    rows = counts.groupBy("division").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(bare, F.col("n"))), F.lit(0)).alias("bare"), codes.alias("c"))
    return rows.select("division", "n", "bare", F.transform("c", lambda x: F.struct(x["code"].alias("code"), (-x["o"]).alias("n"))).alias("codes"))


def size_document(companies: DataFrame, bands: DataFrame) -> DataFrame:
    """One nested row: the bands of a codebook (``bands``: pos, code, label) in its order, with their companies, none as 0."""
    counts = companies.groupBy(F.col("band").alias("code")).agg(F.count("*").alias("n"))
    rows = bands.join(counts, "code", "left").select(F.struct("pos", "code", "label", F.coalesce("n", F.lit(0)).alias("n")).alias("r"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["code"].alias("code"), r["label"].alias("label"), r["n"].alias("n"))).alias("sizes"))


def region_document(companies: DataFrame, names: DataFrame) -> DataFrame:
    """One nested row: regions (the first five characters of districts) with name (null if unknown), largest first, then by code."""
    region = F.substring("district", 1, 5).alias("code")
    counts = companies.where("coalesce(district, '') <> ''").groupBy(region).agg(F.count("*").alias("n"))
    rows = counts.join(names.select("code", "name"), "code", "left").select(F.struct((-F.col("n")).alias("o"), "code", "name").alias("r"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["code"].alias("code"), r["name"].alias("name"), (-r["o"]).alias("n"))).alias("regions"))


def place_points(*layers: DataFrame) -> DataFrame:
    """code, lon, lat of places from layers of outlines (code, rings); a code of several layers is the last one's."""
    every = layers[0].select("code", "rings", F.lit(0).alias("__layer"))
    for n, layer in enumerate(layers[1:], 1):
        every = every.unionByName(layer.select("code", "rings", F.lit(n).alias("__layer")))
    last = every.groupBy("code").agg(F.max_by("rings", "__layer").alias("rings"))
    return centroid(last.where(F.size(F.flatten("rings")) > 0))
