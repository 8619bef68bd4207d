"""Quality scores by Bradley-Terry ranking of preference pairs.

Features are shares and moments of a text alone.  Training draws pairs of one accepted
and one rejected document and fits weights by logistic loss on the difference of their
features: P(a preferred to b) = sigmoid(w . (x_a - x_b)).  The strength w . x becomes a
score between 0 and 1 by centring it on the quantile of the training strengths that
equals the share of rejected documents, so a score of 0.5 is that quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

FEATURES = (
    "log_chars", "log_words", "word_chars", "upper_share", "digit_share", "space_share", "newline_share", "comma_share",
    "stop_share", "mark_share", "symbol_share", "pipe_share", "bang_share", "non_ascii_share", "repeat_share", "distinct_share",
    "upper_word_share", "long_line_share", "line_repeat_share", "worst_block_symbols", "worst_block_upper", "worst_block_repeat",
)

_UPPER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=np.int64) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#$%&*+<=>@^_`{|}~\\"]] = 1
_MARKS = [ord(c) for c in "\"'()-/:;?[]"]
_BLOCK_WORDS = 40


def _features(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    same = list(map(eq, words, words[1:]))
    blocks = [(0.0, 0.0, 0.0)]
    for at in range(0, len(words), _BLOCK_WORDS):
        part = "".join(words[at : at + _BLOCK_WORDS])
        size = max(1, len(part))
        low = part.lower()
        letters = sum(map(part.count, "#$%&*|!"))
        upper = len(part) - sum(map(eq, part, low)) if len(low) == len(part) else 0
        blocks.append((letters / size, upper / size, sum(same[at : at + _BLOCK_WORDS]) / _BLOCK_WORDS))
    worst = np.max(blocks, axis=0)
    share = lambda i: float(counts[i]) / n
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), min(40.0, len(data) / w) / 10, float(counts @ _UPPER) / n, float(counts @ _DIGIT) / n,
        share(32), share(10), share(44), share(46), float(counts[_MARKS].sum()) / n, float(counts @ _SYMBOL) / n, share(124), share(33),
        float(counts[128:].sum()) / n, sum(same) / w, len(set(words)) / w**0.9, sum(map(str.isupper, words)) / w,
        sum(len(x) > 400 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), *map(float, worst),
    ]


def features(text: str | None) -> list[float]:
    """The values of FEATURES for one text; a null text is an empty one."""
    return _features(text or "")


@dataclass(frozen=True)
class QualityModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    centre: float
    spread: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - np.array(self.mean)) / np.array(self.scale), -6, 6)
        return 1 / (1 + np.exp(-np.clip((x @ np.array(self.weights) - self.centre) / self.spread, -40, 40)))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, pairs: int = 40_000, rounds: int = 400, penalty: float = 1e-3, seed: int = 5) -> QualityModel:
    """Fit on a bounded feature matrix; without both labels every score is 0.5."""
    if len(rows) == 0 or labels.min() == labels.max():
        k = len(FEATURES)
        return QualityModel((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 1.0)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = np.clip((rows - mean) / scale, -6, 6)
    random = np.random.default_rng(seed)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    difference = x[random.choice(good, pairs)] - x[random.choice(bad, pairs)]
    w, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        lost = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
        velocity = 0.9 * velocity + (lost @ difference) / pairs - penalty * w
        w = w + 0.2 * velocity
    strength = x @ w
    low, high = strength[bad], strength[good]
    # The quantile of the rejected share, moved to the middle of the gap around it.
    cut = np.quantile(strength, len(bad) / len(strength))
    below, above = strength[strength < cut], strength[strength >= cut]
    centre = float((below.max() + above.min()) / 2) if len(below) and len(above) else float(cut)
    return QualityModel(tuple(mean), tuple(scale), tuple(w), centre, float(max(1e-3, (high.mean() - low.mean()) / 8)))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``' other columns unread: the kept ones are those selected before the call."""
    schema = StructType([*docs.drop(text_col).schema.fields, StructField("features", ArrayType(DoubleType()))])
    others = [c for c in docs.columns if c != text_col]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(rows, pa.list_(pa.float64()))], names=[*others, "features"])

    return docs.mapInArrow(add, schema)


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_labelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``max_labelled`` labelled rows, those of the smallest hash of the id.

    ``usable`` (over ``id_col``) says which labelled rows may be learnt from.  Only the
    feature vectors of that bounded sample (about 180 bytes each) reach the driver.
    Repeated labels are one; of documents that repeat an id the rows count each, within
    the bound.  Ties of the hash go by the id, then the label, then the features.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).withColumn(id_col, F.col("k"))
    chosen = known.where(usable & F.col("y").isin(0, 1)).select("k", "y").distinct().orderBy(F.xxhash64("k"), "k", "y").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "k").select("k", "y", "text")
    table = with_features(sample).orderBy(F.xxhash64("k"), "k", "y", "features").limit(max_labelled).toPandas()
    order = np.lexsort(np.array(table["features"].tolist()).T) if len(table) else []
    rows = np.array(table["features"].tolist()).reshape(-1, len(FEATURES))[order] if len(table) else np.zeros((0, len(FEATURES)))
    return fit_pairs(rows, table["y"].to_numpy()[order] if len(table) else np.zeros(0))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score between 0 and 1 (0.5 and more: accepted).

    Null, empty and blank texts are scored as the empty text.  A column that is already
    called ``score_col`` is replaced.
    """
    docs = docs.drop(score_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    at = docs.columns.index(text_col)
    names = [f.name for f in schema]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                values = model.score(np.array([features(t) for t in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=names)

    return docs.mapInArrow(add, schema)
