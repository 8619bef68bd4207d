"""Joins of many rows with one, where one value of the key may hold any share of the many, and
joins of wide rows with a list of keys, where only rows that may be on the list are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to one task; a key with more is dealt over several.
HEAVY = 2_000
#: Keys at most that are broadcast, with a number each.
BROADCAST_KEYS = 500_000
#: Bits of a broadcast bitmap for each key, bits of one of its rows, and bits at most (32 MB).
BITS_PER_KEY, ROW_BITS, MOST_BITS = 16, 1 << 15, 1 << 28


def salts(counts: DataFrame, on: str, count: str = "count") -> DataFrame:
    """on, parts: the keys of ``counts`` with more than HEAVY rows, and over how many tasks to deal them.

    The bound rises tenfold until the list may be broadcast.
    """
    bound = HEAVY
    while True:
        heavy = counts.where(F.col(count) > bound).select(on, F.ceil(F.col(count) / bound).cast("int").alias("parts"))
        if counts.where(F.col(count) > bound).count() <= BROADCAST_KEYS:
            return heavy
        bound *= 10


def many_to_one(many: DataFrame, one: DataFrame, on: str, heavy: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (unique by ``on``); rows of ``heavy`` keys are dealt by the hash of ``spread``.

    A heavy key's row of ``one`` is there once for each of its parts; nothing else is repeated.
    """
    heavy = F.broadcast(heavy)
    left = many.join(heavy, on, "left").withColumn("__salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("parts"))).cast("int")).drop("parts")
    right = one.join(heavy, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [on, "__salt"], how).drop("__salt")


def maybe_among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with __maybe: true where ``key`` is a value of the one column of ``keys``, of the same
    type (null is a value, too), and for at most one in BITS_PER_KEY of the other keys.

    The hashes of the values are broadcast as a bitmap of two bytes a value.  Beyond MOST_BITS
    the share of other keys rises; none is ever missed.
    """
    rows_of_bits = min(MOST_BITS // ROW_BITS, -(-max(1, keys.count()) * BITS_PER_KEY // ROW_BITS))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(rows_of_bits * ROW_BITS))
    number, bit = (lambda c: F.floor(place(c) / ROW_BITS)), (lambda c: place(c) % ROW_BITS)
    value = F.col(keys.columns[0])
    bitmap = keys.groupBy(number(value).alias("__number")).agg(F.bitmap_construct_agg(bit(value)).alias("__bits"))
    byte = F.col("__bits").substr((F.floor(bit(key) / 8) + 1).cast("int"), F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (bit(key) % 8).cast("int")) == 1
    return rows.join(F.broadcast(bitmap), number(key) == F.col("__number"), "left").withColumn("__maybe", F.coalesce(found, F.lit(False))).drop("__number", "__bits")


def among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is a value of ``keys``; few others are shuffled."""
    asked = maybe_among(rows, key, keys).where("__maybe").drop("__maybe")
    return asked.join(keys, key.eqNullSafe(F.col(keys.columns[0])), "left_semi")


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is no value of ``keys``; few of them are shuffled."""
    marked = maybe_among(rows, key, keys)
    asked = marked.where("__maybe").drop("__maybe")
    return marked.where("not __maybe").drop("__maybe").unionByName(asked.join(keys, key.eqNullSafe(F.col(keys.columns[0])), "left_anti"))
