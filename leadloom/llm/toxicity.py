"""Toxic spans by a linear-chain conditional random field, and document scores from it.

Tokens are runs of characters other than white space.  A token's features are its
letters in lower case (the word) and the word's beginnings of four to six letters.
Document labels become token labels in training: features are picked greedily that
occur almost only in toxic documents and cover toxic documents not covered yet; a token
of a toxic document that has a picked feature is labelled toxic.  The field has two
states; each line is split into consecutive chains of CHAIN tokens, in training as in
tagging.  Forward-backward marginals give each
token's probability; a document's score is the calibrated chance that any token is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .store import discard, materialize

CHAIN = 256
#: Tokens of a lower probability don't count in a document's score, or length alone would raise it.
FLOOR = 0.02
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_CACHE_WORDS = 1_000_000


def token_features(token: str) -> tuple[str, ...]:
    """The word in a token, marked ``=``, and its beginnings, marked ``^``."""
    found = _WORD.search(token)
    if not found:
        return ()
    word = found[0].lower()
    return ("=" + word, *("^" + word[:k] for k in (4, 5, 6) if len(word) >= k))


class _Odds(dict):
    """exp of each token's own weight; a token is looked up once."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias
        self.heads = {f[1:5] for f in weights}  # all features of a word share its first letters
        self.base = float(np.exp(min(30.0, max(-30.0, bias))))

    def __missing__(self, token: str) -> float:
        if len(self) > _CACHE_WORDS:
            self.clear()
        found = _WORD.search(token)
        if not found or found[0][:4].lower()[:4] not in self.heads:
            self[token] = self.base
            return self.base
        get = self.weights.get
        value = self[token] = float(np.exp(min(30.0, max(-30.0, self.bias + sum(get(f, 0.0) for f in token_features(token))))))
        return value


@dataclass
class Chain:
    """Probabilities of a chain's tokens, and the log of the chance that none is toxic."""

    probability: np.ndarray
    none: float


@dataclass
class ToxicityModel:
    """Weights of the field (state 1 against state 0) and of the calibration."""

    weights: dict[str, float]
    bias: float
    start: float
    moves: tuple[float, float, float]  # log weights of 0->1, 1->0, 1->1; that of 0->0 is 0
    slope: float
    offset: float

    def __post_init__(self):
        self._odds = _Odds(self.weights, self.bias)
        self._plain: dict[int, Chain] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _solve(self, chains: list[list[float]]) -> list[Chain]:
        out: list[Chain] = [Chain(np.zeros(0), 0.0)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            x, mask = _padded([chains[i] for i in part])
            q, b, _ = forward_backward(x, mask, self.start, self.moves)
            p = q * b / (1 + q * b)
            none = np.log1p(-np.where(p >= FLOOR, np.minimum(p, 1 - 1e-9), 0.0)).sum(axis=1)
            for k, i in enumerate(part):
                out[i] = Chain(p[k, : len(chains[i])], float(none[k]))
        return out

    def tag(self, texts: Sequence[str | None]) -> list[list[Chain]]:
        """The chains of each text.  Chains without any known feature differ by length alone."""
        base = self._odds[""]
        look = self._odds.__getitem__
        tags: list[list[Chain | int]] = []
        open_chains: list[list[float]] = []
        for text in texts:
            own: list = []
            for line in (text or "").split("\n"):
                tokens = line.split()
                for i in range(0, len(tokens), CHAIN):
                    odds = list(map(look, tokens[i : i + CHAIN]))
                    if odds.count(base) == len(odds):
                        if len(odds) not in self._plain:
                            self._plain[len(odds)] = self._solve([odds])[0]
                        own.append(self._plain[len(odds)])
                    else:
                        own.append(len(open_chains))
                        open_chains.append(odds)
            tags.append(own)
        solved = self._solve(open_chains)
        return [[solved[c] if isinstance(c, int) else c for c in own] for own in tags]

    def evidence(self, chains: list[Chain]) -> float:
        """Logit of the chance that any token of a text is toxic; an empty text has the least."""
        none = sum(c.none for c in chains)
        return float(np.log(max(-np.expm1(none), 1e-12)) - max(none, -27.6))

    def score(self, chains: list[Chain]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.evidence(chains) + self.offset, -40, 40))))


def _padded(chains: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, chains), dtype=np.int64, count=len(chains))
    mask = np.arange(lengths.max(initial=0)) < lengths[:, None]
    x = np.zeros(mask.shape)
    x[mask] = np.fromiter((v for c in chains for v in c), dtype=float, count=int(lengths.sum()))
    return x, mask


def forward_backward(x: np.ndarray, mask: np.ndarray, start: float, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float]]:
    """Ratios of state 1 to state 0 of the forward and backward sums, per chain and token."""
    up, down, stay = np.exp(moves)
    n, steps = x.shape
    q, b = np.zeros((steps, n)), np.ones((steps, n))
    xt, mt = np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)
    if steps:
        q[0] = xt[0] * np.exp(start)
    for t in range(1, steps):
        q[t] = xt[t] * (up + stay * q[t - 1]) / (1 + down * q[t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = xt[t + 1] * b[t + 1]
        b[t] = np.where(mt[t + 1], (down + stay * ahead) / (1 + up * ahead), 1.0)
    return np.where(mask, q.T, 0.0), b.T, (up, down, stay)


def document_features(text: str) -> set[str]:
    return {f for w in set(text.split()) for f in token_features(w)}


def pick_markers(texts: list[str], labels: np.ndarray, least: int = 3, precision: float = 0.9) -> tuple[list[str], list[str]]:
    """Features that tell toxic documents, picked by how many uncovered ones they cover.

    Also all further features that are as common in toxic documents as in all others together.
    """
    total: Counter[str] = Counter()
    positive: Counter[str] = Counter()
    for text, y in zip(texts, labels):  # no document's features are kept, only counts
        own = document_features(text)
        total.update(own)
        if y:
            positive.update(own)
    total = Counter({f: n for f, n in total.items() if f in positive})
    helpful = [f for f, n in positive.items() if n >= least and n >= 0.5 * total[f]]
    able = {f for f, n in positive.items() if n >= least and n >= precision * total[f]}
    open_docs = [document_features(t) & able for t, y in zip(texts, labels) if y]
    covered = Counter(f for d in open_docs for f in d)
    holders: dict[str, list[int]] = {}
    for i, d in enumerate(open_docs):
        for f in d:
            holders.setdefault(f, []).append(i)
    markers: list[str] = []
    done = [False] * len(open_docs)
    while covered:
        best = max(covered, key=lambda f: (covered[f], len(f), f))
        if covered[best] < least:
            break
        markers.append(best)
        for i in holders[best]:
            if not done[i]:
                done[i] = True
                covered.subtract(open_docs[i])
        covered = +covered
    # Further features as common as the picked ones, whose documents those have covered.
    common = 0.3 * max((positive[f] for f in markers), default=0)
    return markers + sorted(f for f in able - set(markers) if positive[f] >= max(common, least) and positive[f] >= 0.97 * total[f]), sorted(helpful)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> ToxicityModel:
    """Fit on all chains of a bounded sample; without both labels every score is 0.5 or what the calibration gives.

    Chains in which no token has a feature differ by length alone, so those of one
    length are one chain with their number as its weight.
    """
    unique = {}
    for t, y in zip(texts, labels):
        unique.setdefault(t, int(y))
    texts, labels = list(unique), np.array(list(unique.values()), dtype=int)
    markers, helpful = pick_markers(texts, labels)
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*markers, *helpful]))}
    wanted = set(markers)
    chosen: list[tuple[list[list[int]], list[int], float]] = []
    plain: Counter[int] = Counter()
    for text, y in zip(texts, labels):
        for line in text.split("\n"):
            tokens = line.split()
            for i in range(0, len(tokens), CHAIN):
                names = [token_features(t) for t in tokens[i : i + CHAIN]]
                ids = [[vocabulary[f] for f in n if f in vocabulary] for n in names]
                if any(ids):
                    chosen.append((ids, [int(bool(y) and not wanted.isdisjoint(n)) for n in names], 1.0))
                else:
                    plain[len(names)] += 1
    if not vocabulary or not chosen:
        return ToxicityModel({}, -8.0, -2.0, (-2.0, 0.0, 0.0), 1.0, 0.0)
    chosen += [([[]] * n, [0] * n, float(weight)) for n, weight in plain.items()]
    chosen.sort(key=lambda c: len(c[0]))
    ready = []
    for part in (chosen[i : i + 512] for i in range(0, len(chosen), 512)):
        _, mask = _padded([[1.0] * len(c[0]) for c in part])
        y = np.zeros(mask.shape)
        y[mask] = [v for c in part for v in c[1]]
        at = [(r, t, f) for r, c in enumerate(part) for t, fs in enumerate(c[0]) for f in fs]
        ready.append((mask, y, np.array([c[2] for c in part]), np.array(at, dtype=np.int64).reshape(-1, 3)))
    size = sum(float((m * w[:, None]).sum()) for m, _, w, _ in ready)
    theta = np.concatenate([np.zeros(len(vocabulary)), [-4.0, -1.0, -1.0, 0.0, 0.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        slope = np.zeros_like(theta)
        for mask, y, weight, at in ready:
            own = np.full(mask.shape, theta[-5])
            np.add.at(own, (at[:, 0], at[:, 1]), theta[at[:, 2]])
            x = np.where(mask, np.exp(np.clip(own, -30, 30)), 0.0)
            q, b, (up, down, stay) = forward_backward(x, mask, theta[-4], tuple(theta[-3:]))
            p = q * b / (1 + q * b)
            gap = (y - p) * mask * weight[:, None]
            np.add.at(slope, at[:, 2], gap[at[:, 0], at[:, 1]])
            slope[-5] += gap.sum()
            slope[-4] += gap[:, 0].sum()
            both = (mask[:, 1:] * weight[:, None]).astype(float)
            ahead = x[:, 1:] * b[:, 1:]
            q0 = q[:, :-1]
            total = 1 + up * ahead + q0 * (down + stay * ahead)
            y0, y1 = y[:, :-1], y[:, 1:]
            slope[-3] += (((1 - y0) * y1 - up * ahead / total) * both).sum()
            slope[-2] += ((y0 * (1 - y1) - q0 * down / total) * both).sum()
            slope[-1] += ((y0 * y1 - q0 * stay * ahead / total) * both).sum()
        slope = slope / size * 1000 - penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in vocabulary.items() if abs(theta[i]) > 1e-6}
    model = ToxicityModel(weights, float(theta[-5]), float(theta[-4]), (float(theta[-3]), float(theta[-2]), float(theta[-1])), 1.0, 0.0)
    value = np.array([model.evidence(tags) for tags in model.tag(texts)])
    slope, offset = _calibrate(value, labels)
    return ToxicityModel(weights, model.bias, model.start, model.moves, slope, offset)


def _calibrate(value: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one value; classes weigh alike and the slope stays positive."""
    if labels.min() == labels.max():
        return 1.0, 0.0
    middle, scale = float(value.mean()), float(value.std()) + 1e-6
    v = (value - middle) / scale
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    a, c = 1.0, 0.0
    for _ in range(500):
        gap = weight * (labels - 1 / (1 + np.exp(-np.clip(a * v + c, -40, 40))))
        a = max(0.05, a + 2 * float((gap * v).sum()) - 2e-4 * a)
        c += 2 * float(gap.sum())
    return a / scale, c - a * middle / scale


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, max_labelled: int = 1_500, max_chars: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents, whole texts.

    The bounds: at most ``max_labelled`` ids of each label, those of the smallest hash of
    the id (ties by the id), of their distinct rows the first 2 * ``max_labelled``, and of
    these the shortest that have ``max_chars`` characters together, so that a long text
    leaves out itself and no other.  Raises if there are rows and none fits.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).withColumn(id_col, F.col("k")).where(usable)
    parts = [known.where(F.col("y") == y).select("k", "y").distinct().orderBy(F.xxhash64("k"), "k").limit(max_labelled) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("k"), text).join(F.broadcast(chosen), "k").select("k", "y", "text", F.xxhash64("text").alias("hash"), F.length("text").alias("chars"))
    found = materialize(rows, "labelled")
    # Only keys and lengths are sorted and counted; whole texts leave their tasks once they are known to fit.
    slim = found.select("k", "y", "hash", "chars").distinct().orderBy(F.xxhash64("k"), "k", "y", "hash").limit(2 * max_labelled).collect()
    kept, total = [], 0
    for row in sorted(slim, key=lambda r: r["chars"]):
        total += row["chars"]
        if total > max_chars:
            break
        kept.append((row["k"], row["y"], row["hash"]))
    if slim and not kept:
        raise ValueError(f"no labelled text has at most {max_chars} characters")
    wanted = F.broadcast(docs.sparkSession.createDataFrame(kept, found.select("k", "y", "hash").schema))
    table = found.join(wanted, ["k", "y", "hash"], "left_semi").select("k", "y", "text").distinct().toPandas().sort_values(["k", "y", "text"])
    discard(found)
    return fit(table["text"].tolist(), table["y"].to_numpy())


def tag_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of ``docs``, ``toxicity`` (0 to 1) and ``toxic_spans``.

    A span has start and end (code points) and the probability of its most toxic token;
    neighbouring tokens of probability ``least`` or more make one span.  Null, empty and
    blank texts have the least score and no spans.  Columns that already have these two
    names are replaced.
    """
    docs = docs.drop("toxicity", "toxic_spans")
    place = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("probability", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType()), StructField("toxic_spans", ArrayType(place))])
    at = docs.columns.index(text_col)
    names = [f.name for f in schema]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = part.column(at).to_pylist()
                tags = model.tag(texts)
                scores = pa.array([model.score(t) for t in tags], pa.float64())
                spans = pa.array([_spans(x or "", t, least) for x, t in zip(texts, tags)], span)
                yield pa.RecordBatch.from_arrays([*part.columns, scores, spans], names=names)

    return docs.mapInArrow(add, schema)


def _spans(text: str, tags: list[Chain], least: float) -> list[dict]:
    if not any((c.probability >= least).any() for c in tags):
        return []
    found: list[dict] = []
    chains, offset = iter(tags), 0
    for line in text.split("\n"):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(line)]
        for i in range(0, len(tokens), CHAIN):
            joined = False
            for (start, end), p in zip(tokens[i : i + CHAIN], next(chains).probability):
                if p >= least and joined:
                    found[-1] |= {"end": offset + end, "probability": max(found[-1]["probability"], float(p))}
                elif p >= least:
                    found.append({"start": offset + start, "end": offset + end, "probability": float(p)})
                joined = bool(p >= least)
        offset += len(line) + 1
    return found
