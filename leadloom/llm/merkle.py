"""A Merkle manifest of a dataset: leaves, subroots, a root, and a proof for each row.

Rows are leaves of their part's tree, by id; every ARITY consecutive nodes make one node of
the next level until one is left, the part's subroot.  Subroots, by part, make the root in
the same way.

1. Leaves are hashed where the rows are read and written as a slim table; only digests and
   keys are shuffled from there on.  Places within a part come from a range partitioning and
   the counts of each range, so no part is sorted in one task.
2. ``span`` levels of a tree are one block: a part's leaves are cut into superblocks of
   ARITY ** span, reduced to one node each, and these nodes again, until each tree has one
   block left.  That takes log(rows) / span rounds of shrinking tables.
3. On the way back, each block's nodes and the outer nodes that its proofs need (a few for
   each level above, not the tree) are cogrouped by superblock in ``applyInPandas``: one
   call reduces the block, joins its nodes' proofs and, for leaves, folds them.

A block is a bounded group however many rows a part has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import BROADCAST_KEYS, many_to_one, salts
from .store import discard, materialize

#: Nodes that make one node, and levels of a tree that one group reduces (ARITY ** SPAN nodes).
ARITY, SPAN = 2, 12


def field(value: Column) -> Column:
    """A value as a leaf holds it: its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(nodes: int) -> int:
    """Levels above the leaves of a tree of so many."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def reduce_block(digests: list[str], levels: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The node ``levels`` above a run of nodes; of each node, level by level, its siblings to the left and right.

    The paths of all nodes are told by level: places at level k are node >> k.
    """
    paths = []
    for _ in range(levels):
        own, made = [], []
        for at in range(0, len(digests), ARITY):
            run = digests[at : at + ARITY]
            own += [(run[:k], run[k + 1 :]) for k in range(len(run))]
            made.append(node_digest(run))
        paths.append(own)
        digests = made
    return digests[0], paths


def path_of(paths: list[list[tuple[list[str], list[str]]]], node: int) -> list[tuple[list[str], list[str]]]:
    return [own[node // ARITY**k] for k, own in enumerate(paths)]


def pack(path: list[tuple[list[str], list[str]]]) -> str:
    """A path as text: levels by blanks, siblings left and right of the node by a bar."""
    return " ".join(",".join(left) + "|" + ",".join(right) for left, right in path)


def unpack(text: str) -> list[tuple[list[str], list[str]]]:
    cut = lambda x: x.split(",") if x else []
    return [tuple(map(cut, level.split("|"))) for level in text.split(" ")] if text else []


def fold(digest: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        digest = node_digest([*left, digest, *right])
    return digest


def proof(path: list[tuple[list[str], list[str]]]) -> str:
    """Digest of all siblings of a path, in order; that of nothing where there are none."""
    return node_digest([s for left, right in path for s in (*left, *right)])


def placed(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``place``, their place in their ``tree`` by ``order``, from 0, and ``nodes``, the tree's rows; the tables to discard.

    ``rows`` are a written table.  They are partitioned by ranges, written with their range,
    counted for each range and tree, and numbered within their range.
    """
    # Rows that agree in the whole order are dealt apart by a number of their own; which of them comes first changes nothing.
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "__own"]
    ranged = materialize(rows.withColumn("__own", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(F.col(tree).alias("__tree"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__tree").orderBy("__r")
    # As many rows as ranges and trees together.
    starts = materialize(sizes.select("__tree", "__r", (F.sum("__n").over(before) - F.col("__n")).alias("__start"), F.sum("__n").over(W.partitionBy("__tree")).alias("nodes")), "starts")
    within = W.partitionBy("__range", tree).orderBy(*keys[1:])
    numbered = ranged.withColumn("__row", F.row_number().over(within))
    same = (F.col("__range") == F.col("__r")) & F.col(tree).eqNullSafe(F.col("__tree"))
    known = F.broadcast(starts) if starts.count() <= BROADCAST_KEYS else starts
    return numbered.join(known, same).select(*rows.columns, (F.col("__start") + F.col("__row") - 1).alias("place"), "nodes"), [ranged, starts]


def _block_of(frame: pd.DataFrame, span: int) -> tuple[pd.DataFrame, str, list[list[tuple[list[str], list[str]]]]]:
    """The rows of a superblock by place, the node that it is reduced to, and the siblings on its levels."""
    frame = frame.sort_values("place")
    return frame, *reduce_block(frame["digest"].tolist(), min(span, levels_of(int(frame["nodes"].iat[0]))))


def _blocked(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {ARITY**span}"))


def block_roots(nodes: DataFrame, span: int) -> DataFrame:
    """The node that each superblock of ``nodes`` (tree, place, nodes, digest) is reduced to."""
    size = ARITY**span

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        frame, top, _ = _block_of(frame, span)
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "place": frame["place"].iloc[:1] // size, "nodes": -(-frame["nodes"].iloc[:1] // size), "digest": [top]})

    own = _blocked(nodes.select("tree", "place", "nodes", "digest"), span)
    return materialize(own.groupBy("tree", "block").applyInPandas(reduced, "tree long, place long, nodes long, digest string"), "roots")


def finished(nodes: DataFrame, outer: DataFrame, finish: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, span: int) -> DataFrame:
    """The superblocks of ``nodes`` cogrouped with the ``outer`` nodes that they need, and finished."""
    needed = outer.withColumnRenamed("place", "block")
    return _blocked(nodes, span).groupBy("tree", "block").cogroup(needed.groupBy("tree", "block")).applyInPandas(finish, schema)


def prove(nodes: DataFrame, span: int = SPAN) -> DataFrame:
    """tree, place, path, top for each of ``nodes`` (tree, place, nodes, digest; a written table).

    ``top`` is what remains of the tree, ``path`` the siblings from the node up to it.
    """
    schema = "tree long, place long, path string, top string"
    several = nodes.where(F.col("nodes") > ARITY**span)
    if several.isEmpty():
        outer = nodes.sparkSession.createDataFrame([], schema)
    else:
        outer = materialize(prove(block_roots(several, span), span), "outer")

    def proved(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"tree": [], "place": [], "path": [], "top": []})
        block, top, paths = _block_of(block, span)
        rest, top = (above["path"].iat[0], above["top"].iat[0]) if len(above) else ("", top)
        own = [" ".join(x for x in (pack(path_of(paths, k)), rest) if x) for k in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "place": block["place"], "path": own, "top": top})

    return finished(nodes, outer, proved, schema, span)


def _folded(span: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def folded(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Leaves with their digests; ``outer`` has their superblock's path up to the root."""
        if not len(block):
            return pd.DataFrame({c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")})
        block, _, paths = _block_of(block, span)
        above = unpack(outer["path"].iat[0])
        proofs, folds = [], []
        for k, (leaf, changed) in enumerate(zip(block["digest"], block["changed"])):
            path = path_of(paths, k) + above
            proofs.append(proof(path))
            folds.append(fold(changed if isinstance(changed, str) else leaf, path))
        return pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["digest"], "subroot": outer["subroot"].iat[0], "root": outer["root"].iat[0], "proof_sha256": proofs, "folded_root": folds})

    return folded


def manifest(
    docs: DataFrame, fields: list[str], id_col: str = "doc_id", part_col: str = "lang", tampered: dict[str, Column] | None = None, where: Column | None = None, span: int = SPAN
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    A leaf is the digest of ``fields`` (nulls told from empty values).  Leaves of a part
    ascend by id, null ids first; rows that repeat an id go by their leaves, and equal rows
    are as many equal leaves.  Parts ascend bytewise, the null part first.  Where ``where``
    holds, a leaf is recomputed with ``tampered`` in place of some fields, and folded with
    the siblings of the true one; it is not verified unless nothing changed.  An empty
    table has no rows and no root.  Columns that are not named here are not read.
    """
    leaf = leaf_digest(*[F.col(c) for c in fields])
    changed = leaf_digest(*[(tampered or {}).get(c, F.col(c)) for c in fields])
    told = F.when(F.lit(False) if where is None else where, changed).alias("changed")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(part_col).cast("string").alias("part"), leaf.alias("digest"), told), "leaves")
    parts = materialize(rows.groupBy("part").agg(F.count("*").alias("leaves")).withColumn("all", F.lit(0)), "parts")
    ranked, spent = placed(parts, "all", ["part"])
    ranks = materialize(ranked.select("part", F.col("place").alias("rank"), F.col("nodes").alias("parts")), "ranks")
    discard(parts, *spent)
    known = ranks.select(F.col("part").alias("p"), F.col("rank").alias("tree"))
    known = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
    numbered, spent = placed(rows, "part", ["doc_id", "digest"])
    # Ids go to pandas as text: a column of numbers with nulls would become one of floats there.
    numbered = numbered.join(known, F.col("part").eqNullSafe(F.col("p"))).select("tree", "place", "nodes", "digest", F.col("doc_id").cast("string").alias("doc_id"), "changed")
    leaves = materialize(numbered, "placed")
    discard(rows, *spent)
    # Down to one node a part: that of its only superblock, or what the proofs of its superblocks end in.
    first = block_roots(leaves, span)
    outer = materialize(prove(first, span), "outer")
    tops = materialize(outer.where("place = 0").select("tree", F.col("top").alias("subroot")).join(ranks.select(F.col("rank").alias("tree"), "parts"), "tree"), "tops")
    above = materialize(prove(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("parts").alias("nodes"), F.col("subroot").alias("digest")), span), "above")
    of_part = tops.select("tree", "subroot").join(above.select(F.col("place").alias("tree"), F.col("path").alias("higher"), F.col("top").alias("root")), "tree")
    needed = many_to_one(outer, of_part, "tree", salts(first.groupBy("tree").agg(F.count("*").alias("count")), "tree"), F.col("place"))
    needed = needed.select("tree", "place", F.concat_ws(" ", F.when(F.col("path") != "", F.col("path")), F.when(F.col("higher") != "", F.col("higher"))).alias("path"), "subroot", "root")
    made = finished(leaves, needed, _folded(span), "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string", span)
    return made.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))
