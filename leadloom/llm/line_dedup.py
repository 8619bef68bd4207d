"""Line dedup by site-relative frequency.

A line's ratio at a host is the number of the host's pages that contain it, divided by
all pages of the host.  Lines above a ratio go from every page of that host; a line on
one page only is not repeated and has no ratio.  Only hashes of lines are shuffled,
counted before the shuffle; the texts stay where they are read, and the lines to drop
come back as one short list for each host: since the ratios of a host's lines sum to its
mean lines per page, at most lines per page / ratio exceed it, however many pages there
are.  Lists beyond the bound of a broadcast are joined by a shuffle, but never those of
the hosts with the most pages, so that no task gets a hot host's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: So many hosts and lines to drop at most are broadcast (16 bytes and a host name each).
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_ratios(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """host, line (hash of the trimmed line), pages, total, ratio; blank lines and lines of one page don't count."""
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.coalesce("text", F.lit(""))), lambda x: F.trim(x) != ""), _key))
    # A page's mark -- a null line -- counts the page itself, so one pass gives both counts.
    exploded = rows.select("host", F.explode(F.concat(keys, F.array(F.lit(None).cast("long")))).alias("line"))
    # Written, since the totals are counted before both are joined; lines of one page are not needed.
    counts = materialize(exploded.groupBy("host", "line").agg(F.count("*").alias("pages")).where("line is null or pages > 1"), "counts")
    totals = counts.where("line is null").select(F.col("host").alias("h"), F.col("pages").alias("total"))
    return (
        counts.where("line is not null")
        .join(F.broadcast(totals) if totals.count() <= BROADCAST_LINES else totals, F.col("host").eqNullSafe(F.col("h")))
        .select("host", "line", "pages", "total", (F.col("pages") / F.col("total")).alias("ratio"))
    )


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05) -> DataFrame:
    """``docs`` without the lines on more than ``ratio`` of their host's pages.

    ``text_col`` loses such lines (all their occurrences); ``dropped_lines`` counts them
    and ``kept_chars`` has the new length.  Lines are compared trimmed; blank lines are
    never dropped, nor lines of one page, whatever their ratio; a line at the ratio
    exactly stays.  All rows stay: a null or empty text, or one whose lines all go, is
    there with that text.  Pages of a null host are those of one host.  Repeated rows
    count as pages of their own.  Columns that have these two names are replaced.
    """
    frequent = materialize(line_ratios(docs, host_col, text_col).where(F.col("ratio") > ratio).select("host", "line"), "lines")
    lists = frequent.groupBy("host").agg(F.collect_list("line").alias("__drop")).withColumnRenamed("host", "__host")
    others = docs.drop("dropped_lines", "kept_chars")
    same = F.col(host_col).eqNullSafe(F.col("__host"))
    if frequent.count() <= BROADCAST_LINES:
        joined = others.join(F.broadcast(lists), same, "left")
    else:
        joined = _joined(others, lists, host_col, same)
    lines = _lines(F.col(text_col))
    kept = F.when(
        F.col("__drop").isNull() | ~F.arrays_overlap(F.transform(lines, _key), F.coalesce("__drop", F.array().cast("array<bigint>"))), lines
    ).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), _key(x))))
    cleaned = joined.withColumn("__kept", kept)
    return cleaned.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in others.columns],
        F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).alias("dropped_lines"),
        F.coalesce(F.length(F.array_join("__kept", "\n")), F.lit(0)).cast("long").alias("kept_chars"),
    )


def _joined(docs: DataFrame, lists: DataFrame, host_col: str, same: Column) -> DataFrame:
    """``docs`` with their host's list: by broadcast for the hosts with the most pages, by a shuffle for the rest.

    The hosts are cut at a power of two of their pages, as low as the broadcast's bound
    allows; a host is among them whether or not it has lines to drop.
    """
    pages = docs.groupBy(F.col(host_col).alias("__h")).agg(F.count("*").alias("pages"))
    sized = materialize(
        pages.join(lists, F.col("__h").eqNullSafe(F.col("__host")), "left").select(F.col("__h").alias("__host"), F.floor(F.log2("pages")).cast("int").alias("power"), "__drop"), "hosts"
    )
    weight = F.sum(1 + F.greatest(F.size("__drop"), F.lit(0)))
    cut, held = 64, 0
    for row in sized.groupBy("power").agg(weight.alias("n")).orderBy(F.desc("power")).collect():  # one row for each power of two
        held += row["n"]
        if held > BROADCAST_LINES:
            break
        cut = row["power"]
    many, few = sized.where(F.col("power") >= cut).drop("power"), sized.where(F.col("power") < cut).drop("power")
    of_many = docs.join(F.broadcast(many), same)
    of_few = docs.join(F.broadcast(many.select("__host")), same, "left_anti").join(few, same, "left")
    return of_many.unionByName(of_few)
