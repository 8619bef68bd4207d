"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

1. Vectors are normalised in double precision; equal ones form one class.  A class gets a
   bucket in each of several tables: quantised random projections, floor((a . v + b) / w),
   hashed together.  Two unit vectors of cosine c are sqrt(2 - 2 c) apart, which gives the
   chance that they share a bucket; the number of projections follows the number of rows,
   so that buckets of unrelated vectors keep their size, and the number of tables then
   follows from the chance to miss a pair at the threshold (``miss``; closer pairs are
   missed far less).
2. In buckets of more than BALL classes, those so near to the bucket's first one that they
   are all linked with each other (half the threshold's angle) form a ball: its links are
   counted, not compared.  Copies with noise thus take linear work.
3. Classes of a bucket that are not of one ball are compared in pairs of blocks of bounded
   size, in double precision, each pair of classes in the first table only in which they
   meet.  A block gives each class its number of links and the smallest class that it
   reaches there; pairs are never emitted.
4. Components of these edges are found by label propagation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import many_to_one, salts
from .near_dup import components, dealt_blocks
from .store import discard, materialize

#: Width of a projection's cells; chance to miss a pair at the threshold; unrelated vectors in a bucket.
WIDTH, MISS, BUCKET = 2.2, 1e-3, 512
#: Classes of a bucket from which on those around its first class are counted as a ball.
BALL = 512
SEED = 20_11

_SIGNATURE = "id long, key binary, vector binary, buckets array<long>"


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection of two points at a distance is equal."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """Projections in a table, and tables, for so many rows."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * least))), collision(math.sqrt(2))
    wide = max(2, math.ceil(math.log(max(1.0, rows / BUCKET)) / -math.log(far)))
    hit = near**wide
    return wide, 1 if hit >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


@lru_cache(maxsize=4)
def projections(dimensions: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions and the offsets of their cells; the same in every task."""
    random = np.random.default_rng([SEED, dimensions])
    return random.standard_normal((dimensions, count)), random.random(count)


def unit(values: list | None) -> np.ndarray | None:
    """A vector of length 1, or None if it is null, zero or empty, or holds a null or a number that isn't finite."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, dtype=np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    v /= most
    v /= math.sqrt(float(v @ v))
    return v + 0.0  # no negative zero


def bucket_hashes(vectors: np.ndarray, wide: int, tables: int) -> np.ndarray:
    """One 64-bit bucket for each vector and table."""
    directions, offsets = projections(vectors.shape[1], wide * tables)
    cells = np.floor(vectors @ directions / WIDTH + offsets).astype(np.int64).reshape(len(vectors), tables, wide)
    mixed = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(vectors.shape[1]), cells.shape[:2]).copy()
    for j in range(wide):
        mixed ^= cells[:, :, j].view(np.uint64)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], wide: int, tables: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("vector", pa.binary()), ("buckets", pa.list_(pa.int64()))])
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            units = [unit(x) for x in part.column(1).to_pylist()]
            buckets: list[np.ndarray | None] = [None] * len(units)
            for size in {len(u) for u in units if u is not None}:
                rows = [i for i, u in enumerate(units) if u is not None and len(u) == size]
                for i, found in zip(rows, bucket_hashes(np.stack([units[i] for i in rows]), wide, tables)):
                    buckets[i] = found
            raw = [None if u is None else u.tobytes() for u in units]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], schema=schema)


def _cosines(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows key, head, size, vector, other those whose two vectors have a cosine of ``least`` or more."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(3), batch.column(4)):
            x, y = np.frombuffer(a.as_py()), np.frombuffer(b.as_py())
            keep.append(len(x) == len(y) and float(x @ y) >= least)
        yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))


def balls(banded: DataFrame, heads: DataFrame, hot: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """key, ball (a class's key) of the classes in large buckets that are near to the first class of one.

    Classes of one ball are at most half the threshold's angle from its first class, so
    each two of them are linked.
    """
    large = heads.where(F.col("size") > BALL)
    near = many_to_one(banded, large, "bucket", hot, F.col("key")).groupBy("key", "head").agg(F.max("size").alias("size"))
    near = materialize(near, "near")
    heavy = materialize(salts(near.groupBy("head").agg(F.count("*").alias("count")), "head"), "heavy")
    vectors = classes.select("key", "vector")
    pairs = many_to_one(near.join(vectors, "key"), vectors.toDF("head", "other"), "head", heavy, F.col("key")).select("key", "head", "size", "vector", "other")
    inner = math.sqrt((1 + least) / 2) + 1e-9
    within = pairs.mapInArrow(partial(_cosines, least=inner), "key binary, head binary, size long")
    found = materialize(within.groupBy("key").agg(F.max(F.struct("size", "head")).alias("best")).select("key", F.col("best.head").alias("ball")), "balls")
    discard(near, heavy)
    return found


def linked(table: pa.Table, least: float) -> dict[str, list]:
    """Of one or two blocks of a bucket: key, label, the smallest label reached, links of each class that has a link there."""
    n = table.num_rows
    vectors = np.frombuffer(b"".join(table["vector"].to_pylist())).reshape(n, -1)
    buckets = table["buckets"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    keys, labels, weights = table["key"].to_pylist(), table["label"].to_pylist(), table["copies"].to_numpy()
    blocks, low, high, bucket = table["block"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py(), table["bucket"][0].as_py()
    names = sorted(set(labels))
    code = {x: i for i, x in enumerate(names)}
    label = np.array([code[x] for x in labels])
    links, reach = np.zeros(n, dtype=np.int64), np.arange(len(names))
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    edges = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        x, y = np.nonzero(vectors[rows] @ vectors[right].T >= least)
        i, j = rows[x], right[y]
        keep = label[i] != label[j]
        if low == high:
            keep &= i < j
        i, j = i[keep], j[keep]
        for part in range(0, len(i), 65_536):
            a, b = i[part : part + 65_536], j[part : part + 65_536]
            equal = buckets[a] == buckets[b]
            first = buckets[a][np.arange(len(a)), equal.argmax(axis=1)] == bucket
            a, b = a[first], b[first]
            links += np.bincount(a, weights[b], n).astype(np.int64) + np.bincount(b, weights[a], n).astype(np.int64)
            edges.append(np.unique(np.stack([label[a], label[b]], axis=1), axis=0))
    if edges:
        ends = np.unique(np.concatenate(edges), axis=0)
        while len(ends):
            before = reach.copy()
            least_of = np.minimum(reach[ends[:, 0]], reach[ends[:, 1]])
            np.minimum.at(reach, ends[:, 0], least_of)
            np.minimum.at(reach, ends[:, 1], least_of)
            reach = reach[reach]
            if (reach == before).all():
                break
    rows = np.flatnonzero(links).tolist()
    return {"key": [keys[i] for i in rows], "label": [labels[i] for i in rows], "reach": [names[reach[label[i]]] for i in rows], "links": links[rows].tolist()}


_FOUND = pa.schema([("key", pa.binary()), ("label", pa.binary()), ("reach", pa.binary()), ("links", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, low, high; a group of them is held at a time."""
    held: list[pa.RecordBatch] = []

    def group() -> Iterator[pa.RecordBatch]:
        found = linked(pa.Table.from_batches(held), least)
        held.clear()
        if found["key"]:
            yield pa.RecordBatch.from_pydict(found, schema=_FOUND)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            mark = tuple(marks[:, start].tolist())
            if mark != last and held:
                yield from group()
            last = mark
            held.append(batch.slice(start, end - start))
    if held:
        yield from group()


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows``.

    Two vectors are linked if their cosine, in double precision, is ``least`` or more; each
    linked pair is found but with a chance of ``miss`` at most.  n_links counts the other
    vectors that a row is linked with, component_id is the smallest id that it reaches over
    links, kept marks the row that has it.  Vectors that are null, empty or zero, or hold a
    null or a number that isn't finite, link with nothing, nor do vectors of different
    dimensions.  Equal vectors are linked, rows that repeat an id are vectors of their own.
    A row without an id gets its component's id and is kept only if no row there has one.
    Other columns are not read.
    """
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    wide, tables = plan(source.count(), least, miss)
    signed = materialize(source.mapInArrow(partial(_sign, wide=wide, tables=tables), _SIGNATURE), "signed")
    own_class = materialize(signed.select("id", "key"), "own")
    first = [F.first(c).alias(c) for c in ("vector", "buckets")]
    classes = materialize(signed.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), *first), "classes")
    discard(signed)
    banded = classes.select("key", F.explode("buckets").alias("bucket"))
    heads = materialize(banded.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    hot = materialize(salts(heads, "bucket", "size"), "hot")
    ball = balls(banded, heads, hot, classes, least)
    named = many_to_one(banded, heads.select("bucket"), "bucket", hot, F.col("key")).join(ball, "key", "left")
    members = materialize(named.select("bucket", "key", F.coalesce("ball", "key").alias("label")), "members")
    spread = materialize(dealt_blocks(members, hot).drop("small"), "blocks")
    often = materialize(salts(spread.groupBy("key").agg(F.count("*").alias("count")), "key"), "often")
    described = many_to_one(spread, classes.select("key", "vector", "buckets", "copies"), "key", often, F.hash("bucket", "low", "high"))
    described = described.select("bucket", "low", "high", "block", "key", "label", "vector", "buckets", "copies")
    sorted_rows = described.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = materialize(sorted_rows.mapInArrow(partial(_compare, least=least), "key binary, label binary, reach binary, links long"), "found")
    discard(heads, hot, members, spread, often)
    labels = components(found.where("label != reach").select(F.col("label").alias("a"), F.col("reach").alias("b")).distinct())
    return _placed(own_class, classes, ball, found, labels)


def _placed(own_class: DataFrame, classes: DataFrame, ball: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the links and the component of their class."""
    crossing = found.groupBy("key").agg(F.sum("links").alias("crossing"))
    of_class = classes.select("key", "first_id", "copies").join(ball, "key", "left").withColumn("label", F.coalesce("ball", "key")).drop("ball").join(crossing, "key", "left")
    of_class = materialize(of_class, "of_class")
    whole = materialize(of_class.groupBy("label").agg(F.sum("copies").alias("inside"), F.min("first_id").alias("first"), F.count("*").alias("size")), "whole")
    joined = whole.join(labels.toDF("label", "top"), "label", "left").withColumn("top", F.coalesce("top", "label"))
    joined = materialize(joined, "joined")
    tops = materialize(joined.groupBy("top").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "tops")
    of_label = many_to_one(joined.select("label", "inside", "top"), tops.drop("size"), "top", salts(tops, "top", "size"), F.col("label"))
    large = materialize(salts(whole, "label", "size"), "large")
    told = many_to_one(of_class.select("key", "copies", "label", "crossing"), of_label.select("label", "inside", "component_id"), "label", large, F.col("key"))
    told = materialize(told.select("key", "copies", "component_id", (F.col("inside") - 1 + F.coalesce("crossing", F.lit(0))).alias("n_links")), "told")
    discard(of_class, whole, joined, tops, large, classes, ball, found)
    rows = many_to_one(own_class, told.drop("copies"), "key", salts(told, "key", "copies"), F.col("id"), "left")
    component = F.coalesce("component_id", "id")
    return rows.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
