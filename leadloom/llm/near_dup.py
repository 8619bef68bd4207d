"""Near-duplicate documents: MinHash bands, odd-sketch estimates, exact confirmation.

1. Each text becomes its set of word shingles, 128 MinHash samples, 24 band keys of
   four samples each, and an odd sketch: a 512-bit parity bitmap of the samples.
   Texts with equal sets form one class, so copies never meet as pairs.
2. Each class of a bucket is compared with the bucket's first class (a star, linear
   in the bucket).  The XOR of two odd sketches estimates their similarity; pairs far
   below the threshold go, all others are confirmed on the full sets.
3. Buckets whose classes are then not all in one component are compared in blocks of
   bounded size, class against class, but only across components, and only in the
   first bucket that two classes share: first on sketches alone, which tells what
   classes have a likely partner in a block; only these fetch their texts and are
   confirmed, in smaller blocks.  Neither step emits pairs that are no links.
4. Components of the links are found by label propagation with pointer jumping.

Joins on a bucket, a class or a component deal the rows of a hot one over many tasks.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6, and
the sketch filter stands five standard deviations below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .joins import BROADCAST_KEYS, among, many_to_one, maybe_among, salts, without
from .shingles import MinHasher, band_keys, odd_sketch, shared, shingle_sets
from .store import discard, materialize

SAMPLES, BANDS, ROWS, BITS = 128, 24, 4, 512
#: Pairs whose estimated similarity is this far below the threshold are not confirmed.
MARGIN = 0.2
#: Classes in a block whose texts are compared, and such blocks in one whose sketches are.
BLOCK, SKETCHED = 512, 4
#: Full sets that a task keeps while it compares two blocks.
SET_BYTES = 32 << 20

_SIGNATURE = "id long, key binary, n long, bands array<long>, sketch array<long>"


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hasher = MinHasher(SAMPLES)
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            sets = list(shingle_sets(part.column(1).to_pylist(), width))
            samples = hasher(sets)
            empty = [len(s) == 0 for s in sets]
            bands, sketch = band_keys(samples, BANDS, ROWS), odd_sketch(samples, BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([None if e else set_key(s) for e, s in zip(empty, sets)], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if e else row for e, row in zip(empty, bands)], pa.list_(pa.int64())),
                    pa.array([None if e else row for e, row in zip(empty, sketch)], pa.list_(pa.int64())),
                ],
                schema=schema,
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, key (of the shingle set), n (its size), bands, sketch; key is null without words."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(partial(_sign, width=width), _SIGNATURE)


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two odd sketches show."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return 1 + BITS / (4 * SAMPLES) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * odd / BITS))


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    odd = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * odd / BITS))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two full sets is at least ``percent`` hundredths."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows a, b, text_a, text_b those whose full sets are similar."""
    last, last_set = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            keys = part.column(1).to_pylist()
            right, keep = part.column(3), []
            for i, s in enumerate(shingle_sets(part.column(2).to_pylist(), width)):
                if keys[i] != last:
                    last, last_set = keys[i], next(shingle_sets([right[i].as_py()], width))
                keep.append(similar(s, last_set, percent))
            yield part.select([0, 1]).filter(pa.array(keep))


def _block(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between the two blocks of one group, or within its one block, across components."""
    table = table.combine_chunks()
    n = table.num_rows
    keys, labels, texts = table["key"].to_pylist(), table["label"].to_pylist(), table["text"]
    blocks = table["block"].to_numpy()
    flat = lambda name: table[name].combine_chunks().flatten().to_numpy().reshape(n, -1)
    bands, sketch = flat("bands"), flat("sketch").view(np.uint64)
    position = {}
    parent = [position.setdefault(x, len(position)) for x in labels]
    root = list(range(len(position)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sets: dict[int, np.ndarray] = {}
    held = 0

    def full(i: int) -> np.ndarray:
        nonlocal held
        if i not in sets:
            if held > SET_BYTES:
                sets.clear()
                held = 0
            sets[i] = next(shingle_sets([texts[i].as_py()], width))
            held += sets[i].nbytes
        return sets[i]

    low, high, bucket = table["low"][0].as_py(), table["high"][0].as_py(), table["bucket"][0].as_py()
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    found: list[tuple[bytes, bytes]] = []
    for at in range(0, len(left), 32):
        rows = left[at : at + 32]
        likely = _estimates(sketch[rows], sketch[right]) >= percent / 100 - MARGIN
        for x, y in zip(*np.nonzero(likely)):
            i, j = int(rows[x]), int(right[y])
            if low == high and j <= i:
                continue
            a, b = find(parent[i]), find(parent[j])
            if a == b or bands[i][bands[i] == bands[j]][0] != bucket:
                continue
            if similar(full(i), full(j), percent):
                root[max(a, b)] = min(a, b)
                found.append((keys[i], keys[j]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def _likely(table: pa.Table, percent: int) -> pa.Table:
    """The classes of one or two blocks that have a likely partner there in another component.

    A class is named once for each pair of small blocks in which it has one.
    """
    table = table.combine_chunks()
    n = table.num_rows
    blocks, small = table["block"].to_numpy(), table["small"].to_numpy()
    flat = lambda name: table[name].combine_chunks().flatten().to_numpy().reshape(n, -1)
    bands, sketch = flat("bands"), flat("sketch").view(np.uint64)
    component = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    low, high, bucket = table["low"][0].as_py(), table["high"][0].as_py(), table["bucket"][0].as_py()
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for at in range(0, len(left), 32):
        rows = left[at : at + 32]
        x, y = np.nonzero((_estimates(sketch[rows], sketch[right]) >= percent / 100 - MARGIN) & (component[rows][:, None] != component[right][None, :]))
        for part in range(0, len(x), 65_536):
            i, j = rows[x[part : part + 65_536]], right[y[part : part + 65_536]]
            equal = bands[i] == bands[j]
            first = bands[i][np.arange(len(i)), equal.argmax(axis=1)] == bucket
            i, j = i[first], j[first]
            near, far = np.minimum(small[i], small[j]), np.maximum(small[i], small[j])
            found.append(np.unique(np.concatenate([np.stack([near, far, i], axis=1), np.stack([near, far, j], axis=1)]), axis=0))
    marked = np.unique(np.concatenate(found), axis=0)
    return pa.table(
        {
            "bucket": pa.array(np.full(len(marked), bucket, dtype=np.int64)), "low": pa.array(marked[:, 0].astype(np.int32)), "high": pa.array(marked[:, 1].astype(np.int32)),
            "block": pa.array(small[marked[:, 2]].astype(np.int32)), "key": table["key"].take(pa.array(marked[:, 2])).combine_chunks(),
        }
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``edges`` (a, b) can reach."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs = materialize(salts(both.groupBy("b").count(), "b"), "hubs")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = many_to_one(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs, F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = materialize(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")), "moved")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far")).where("far < label")
        jumped = many_to_one(moved, jump, "label", salts(moved.groupBy("label").count(), "label"), F.col("node"), "left")
        step = materialize(jumped.select("node", "before", F.least("label", "far").alias("label")), "labels")
        done = step.where(F.col("before") != F.col("label")).isEmpty()
        discard(labels, moved)
        labels = step.select("node", "label")
        if done:
            discard(both, hubs)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two texts are linked if 100 * |A & B| >= ``percent`` * |A | B| for their sets of
    ``width``-word shingles (fewer words: the whole sequence is the one shingle).
    component_id is the smallest id reachable over links; kept marks the row that has
    it.  Null, empty and blank texts have n_shingles 0 and stand alone.  Rows that
    repeat one id are kept or dropped each by its own text.  A row whose id is null
    gets its component's id and is kept only if no row of the component has an id.
    Other columns are not read, so clashing names don't matter.
    """
    return labelled_rows(docs, id_col, text_col, width, percent).drop("set_key", "component_key")


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """:func:`near_duplicates` with set_key, which tells rows of one id apart, and component_key, which
    tells components apart even where no row has an id; both are null for texts without words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(signatures(rows, "id", "text", width), "signatures")
    classes = materialize(
        signed.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    # Of each row only its class is needed from here on; tables go as soon as nothing reads them.
    own_class = materialize(signed.select("id", "n", "key"), "own")
    discard(signed)
    banded = classes.select("key", F.explode("bands").alias("bucket"))
    heads = materialize(banded.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    hot = materialize(salts(heads, "bucket", "size"), "hot")
    shared_buckets = materialize(many_to_one(banded, heads, "bucket", hot, F.col("key")), "buckets")
    discard(heads)
    first = materialize(shared_buckets.select("key").distinct().join(classes.select("key", "first_id"), "key"), "wanted")
    texts = _texts(rows, first, width)
    links = _star_links(shared_buckets, classes, texts, width, percent)
    labels = components(links)
    members = shared_buckets.where("size > 2").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    spread = materialize(dealt_blocks(members, hot), "blocks")
    discard(links, shared_buckets, hot)
    marked = materialize(likely_members(spread, classes, percent), "marked")
    discard(spread)
    described = marked.join(classes.select("key", "bands", "sketch"), "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")).join(texts, "key")
    more = materialize(described.groupBy("bucket", "low", "high").applyInArrow(_block_function(width, percent), "a binary, b binary").distinct(), "more")
    discard(first, texts, marked)
    merged = components(
        more.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    large = materialize(salts(labels.groupBy("label").count(), "label"), "large")
    final = many_to_one(labels.withColumnRenamed("node", "key"), merged.toDF("label", "top"), "label", large, F.col("key"), "left").select("key", F.coalesce("top", "label").alias("top"))
    # Classes without a link of step 2 may have one of step 3.
    found = classes.select("key", "first_id", "copies").join(final, "key", "left").join(merged.toDF("key", "own"), "key", "left")
    named = materialize(found.select("key", "first_id", "copies", F.coalesce("top", "own", "key").alias("top")), "named")
    smallest = materialize(named.groupBy("top").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size")), "smallest")
    of_class = many_to_one(named, smallest.drop("size"), "top", salts(smallest, "top", "size"), F.col("key")).select("key", "component_id", "top", "copies")
    of_class = materialize(of_class, "components")
    placed = many_to_one(own_class, of_class.drop("copies"), "key", salts(of_class, "key", "copies"), F.col("id"), "left")
    discard(classes, labels, more, merged, large, named, smallest)
    component = F.coalesce("component_id", "id")
    return placed.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
        F.col("key").alias("set_key"),
        F.col("top").alias("component_key"),
    )


def _star_links(shared_buckets: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of each class with its buckets' first classes."""
    stars = materialize(shared_buckets.where(F.col("key") != F.col("head")).select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    heavy = materialize(salts(stars.groupBy("b").count(), "b"), "heavy")
    sketches = classes.select("key", "sketch")
    likely = (
        many_to_one(stars.join(sketches.toDF("a", "sketch_a"), "a"), sketches.toDF("b", "sketch_b"), "b", heavy, F.col("a"))
        .where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= percent / 100 - MARGIN)
        .select("a", "b")
    )
    pairs = many_to_one(likely.join(texts.toDF("a", "text_a"), "a"), texts.toDF("b", "text_b"), "b", heavy, F.col("a")).select("a", "b", "text_a", "text_b")
    links = materialize(pairs.mapInArrow(partial(_confirm, width=width, percent=percent), "a binary, b binary"), "links")
    discard(stars, heavy)
    return links


def dealt_blocks(members: DataFrame, hot: DataFrame) -> DataFrame:
    """The members (bucket, key, label) of buckets with several components, dealt to pairs of blocks.

    A bucket's largest component needs no comparison with itself: if it has more than BLOCK
    classes, they have blocks of their own and meet only the others' blocks; a smaller one
    shares blocks with the others, so that a small bucket is one block and its classes are
    sent once.  ``small`` is a member's block of BLOCK classes.
    """
    top = F.max(F.struct("n", "label"))
    open_buckets = members.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(top.alias("top"), F.sum("n").alias("all")).where("all > top.n")
    apart = F.when(F.col("top.n") > BLOCK, F.col("top.n")).otherwise(0)
    in_top = (apart > 0) & (F.col("label") == F.col("top.label"))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    own, rest = blocks(apart, BLOCK), blocks(F.col("all") - apart, BLOCK)
    wide, further = blocks(own, SKETCHED), blocks(rest, SKETCHED)
    hashed = F.xxhash64("key")
    return (
        many_to_one(members.select("bucket", "key", "label"), open_buckets, "bucket", hot, F.col("key"))
        .withColumn("small", F.when(in_top, F.pmod(hashed, F.greatest(own, F.lit(1)))).otherwise(own + F.pmod(hashed, rest)).cast("int"))
        .withColumn("block", F.when(in_top, F.floor(F.col("small") / SKETCHED)).otherwise(wide + F.floor((F.col("small") - own) / SKETCHED)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(in_top, wide).otherwise(F.lit(0)), wide + further - 1)))
        .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "small", "key", "label")
    )


def likely_members(spread: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """bucket, low, high, block, key: of :func:`dealt_blocks` the classes with a likely partner, by small blocks."""

    def likely(table: pa.Table) -> pa.Table:
        return _likely(table, percent)

    described = spread.join(classes.select("key", "bands", "sketch"), "key")
    return described.groupBy("bucket", "low", "high").applyInArrow(likely, "bucket long, low int, high int, block int, key binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component.

    That is the row of the smallest id, null ids last; of rows that share it the one of
    the smallest set key, then of the smallest values of all columns.  Null, empty and
    blank texts stay.  Only rows whose id is null or repeated are told apart by their text.
    Of the others only rows that go, and few that stay, are shuffled with their texts.
    """
    key = F.col(id_col).cast("long")
    rows = materialize(labelled_rows(docs, id_col, text_col, width, percent).select(F.col("doc_id").alias("__id"), F.col("set_key").alias("__key"), F.col("component_key").alias("__component")), "labelled")
    own = F.struct(F.col("__id").isNull().alias("none"), "__id", "__key")
    best = rows.where("__key is not null").groupBy("__component").agg(F.min(own).alias("__best"))
    pairs = rows.where("__key is not null").groupBy("__id", "__key", "__component").agg(F.count("*").alias("__count"))
    judged = materialize(pairs.join(best, "__component").select("__id", "__key", "__count", (own == F.col("__best")).alias("__wins")), "judged")
    many = materialize(rows.groupBy("__id").agg(F.count("*").alias("__n")).where("__id is null or __n > 1").select("__id"), "many")
    discard(rows)
    lost = judged.where("not __wins").select("__id").where("__id is not null")
    if many.isEmpty():
        return without(docs, key, materialize(lost.distinct(), "lost"))
    # Rows of ids that occur once are judged by the id, all others by id and set key.
    once = without(docs, key, materialize(lost.unionByName(many).distinct(), "lost"))
    told = among(docs, key, many)
    marks = judged.where("__wins").join(many.withColumnRenamed("__id", "__many"), F.col("__id").eqNullSafe(F.col("__many")), "left_semi").select("__id", F.col("__key").alias("__want"), "__count")
    keyed = _with_key(told, text_col, width)
    blank = keyed.where("__key is null").select(*docs.columns)
    wins = keyed.join(marks, (F.col("__key") == F.col("__want")) & key.eqNullSafe(F.col("__id")))
    alone = wins.where("__count = 1").select(*docs.columns)
    again = wins.where("__count > 1").groupBy("__want", "__id").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(blank).unionByName(alone).unionByName(again)


def _with_key(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` with __key, the key of each text's shingle set, null without words."""
    at = docs.columns.index(text_col)
    names = [*docs.columns, "__key"]
    schema = StructType([*docs.schema.fields, StructField("__key", BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                keys = [set_key(s) if len(s) else None for s in shingle_sets(part.column(at).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=names)

    return docs.mapInArrow(add, schema)


def _block_function(width: int, percent: int):
    def links(table: pa.Table) -> pa.Table:
        return _block(table, width, percent)

    return links


def _texts(rows: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """key, text of each wanted class; ``first`` has key and the smallest id of its rows.

    Rows that repeat an id with other texts are told apart by the key of their own set.
    """
    wanted = first.where("first_id is not null").select(F.col("key").alias("want"), F.col("first_id").alias("id"))
    if wanted.count() <= BROADCAST_KEYS:
        found = rows.join(F.broadcast(wanted), "id").select("want", "text")
    else:
        found = maybe_among(rows, F.col("id"), wanted.select("id")).where("__maybe").join(wanted, "id").select("want", "text")
    nulls = first.where("first_id is null").select("key")
    found = found.mapInArrow(partial(_own, width=width), "key binary, text string")
    if not nulls.isEmpty():
        plain = rows.where("id is null").select(F.lit(None).cast("binary").alias("want"), "text")
        found = found.unionByName(plain.mapInArrow(partial(_own, width=width), "key binary, text string").join(nulls, "key", "left_semi"))
    return materialize(found.dropDuplicates(["key"]), "texts")


def _own(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            keys = [set_key(s) for s in shingle_sets(part.column(1).to_pylist(), width)]
            keep = [w is None or w == k for w, k in zip(part.column(0).to_pylist(), keys)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(1)], names=["key", "text"]).filter(pa.array(keep))
