"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A piece of n tokens costs n + n * n / ATTENTION_TOKENS: the linear layers and attention
within the piece.  Inside a window of documents, pieces go in descending order each to
the cheapest sequence that still has room.  A piece that fits nowhere whole is cut over
the sequences with most room, so that all sequences of a window but one are full.

A window is a run of rows of one Spark partition of at most WINDOW_TOKENS tokens.  No
row is shuffled and no task holds more than a window; partitions are packed side by
side, and a sequence's id is made of its partition's number and a counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_level

ATTENTION_TOKENS = 1024.0
WINDOW_TOKENS = 8_000_000
#: Rows of an Arrow batch are encoded together up to about so many bytes.
SLICE_BYTES = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(tokens: np.ndarray | float) -> np.ndarray | float:
    return tokens + tokens * tokens / ATTENTION_TOKENS


def pack(lengths: list[int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once.

    Documents are numbers into ``lengths``; ties go to the smaller document and sequence.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rests: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, doc, whole * capacity))
    if not rests:
        return out
    total = sum(r[0] for r in rests)
    bins = -(-total // capacity)
    # Sequence room in tokens; the last sequence has what the others leave over.
    room = np.full(bins, capacity, dtype=np.int64)
    room[-1] = total - capacity * (bins - 1)
    used, spent = np.zeros(bins, dtype=np.int64), np.zeros(bins)
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        open_cost = np.where(room >= n, spent, np.inf)
        at = int(open_cost.argmin())
        while n:
            if room[at] < n:
                at = int(room.argmax())
            piece = int(min(n, room[at]))
            out.append((doc, start, piece, sequence + at, int(used[at])))
            used[at] += piece
            room[at] -= piece
            spent[at] += cost(float(piece))
            start, n = start + piece, n - piece
    return out


def _rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, window: int) -> Iterator[pa.RecordBatch]:
    encoder = byte_level(path)
    end = end_id.to_bytes(4, "little")
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal sequence
        pieces = pack([len(b) // 4 for _, b in held], capacity)
        data = [held[d][1] for d, *_ in pieces]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([held[d][0] for d, *_ in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(b[4 * s : 4 * (s + n)]) for b, (_, s, n, _, _) in zip(data, pieces)], pa.int64()),
                pa.array([len(b) // 4 for b in data], pa.int64()),
                pa.array([sequence + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        sequence += 1 + max(p[3] for p in pieces)
        return batch

    for batch in batches:
        step = 1 + SLICE_BYTES * batch.num_rows // (1 + batch.nbytes)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            encoded = encoder.many([t or "" for t in part.column(1).to_pylist()])
            for doc, ids in zip(part.column(0).to_pylist(), encoded):
                ids += end
                if held and size + len(ids) > 4 * window:
                    yield flush()
                    held, size = [], 0
                held.append((doc, ids))
                size += len(ids)
    if held:
        yield flush()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, window: int = WINDOW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids (its text's ids, then ``end_id``).

    Null and empty texts are one token, the end.  A null id stays null; repeated rows
    are packed once each.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, tokenizer, end_id, capacity, window)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
