"""Vectorised word shingles and MinHash samples for batches of texts.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z in
lower case.  A batch of texts becomes one byte array; word hashes come from
differences of one running polynomial sum, so no Python code runs per word.
Everything here is a helper inside Spark tasks: it sees one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SLICE_BYTES = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``size`` of each."""
    if not _powers or len(_powers[0]) < size:
        n = max(size, _SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    start, size, part = 0, 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if part and size + len(data) > _SLICE_BYTES:
            yield start, part
            start, size, part = i, 0, []
        part.append(data)
        size += len(data) + 1
    if part:
        yield start, part


def word_hashes(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of the text of each word."""
    raw = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
    powers, inverse = _power_tables(len(raw) + 1)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return hashes, owner


def shingle_sets(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending (uint64).

    A text with fewer than ``width`` words, but at least one, has its whole word
    sequence as one shingle; a null or blank text has none.
    """
    for _, part in _slices(texts):
        words, owner = word_hashes(part)
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        n = max(0, len(words) - width + 1)
        combined = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            combined = combined * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
        combined = mix(combined)
        for i in range(len(part)):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= width:
                yield np.unique(combined[lo : hi - width + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for h in words[lo:hi]:
                        short = short * np.uint64(0xD6E8FEB86659FD93) + h
                yield mix(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


class MinHasher:
    """``samples`` MinHash values of each set, by multiply-add permutations."""

    def __init__(self, samples: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.a = random.integers(0, 2**64, samples, dtype=np.uint64) | np.uint64(1)
        self.b = random.integers(0, 2**64, samples, dtype=np.uint64)

    def __call__(self, sets: Sequence[np.ndarray]) -> np.ndarray:
        """An array of one row per set; rows of empty sets are zero."""
        out = np.zeros((len(sets), len(self.a)), dtype=np.uint64)
        full = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        while at < len(full):
            rows, size = [], 0
            while at < len(full) and (not rows or size + len(sets[full[at]]) <= 1 << 16):
                rows.append(full[at])
                size += len(sets[full[at]])
                at += 1
            values = np.concatenate([sets[i] for i in rows])
            starts = np.cumsum([0] + [len(sets[i]) for i in rows[:-1]])
            for k in range(len(self.a)):
                out[rows, k] = np.minimum.reduceat(values * self.a[k] + self.b[k], starts)
        return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of each row of samples: bit p is the parity of the samples hashed to p.

    Returns int64 words, ``bits // 64`` per row.
    """
    n, k = samples.shape
    tagged = mix(samples + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE))
    place = (tagged >> np.uint64(40)) % np.uint64(bits)
    words = np.zeros((n, bits // 64), dtype=np.uint64)
    rows = np.arange(n)
    for j in range(k):
        p = place[:, j]
        words[rows, (p >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (p & np.uint64(63))
    return words.view(np.int64)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 bucket key per band; keys of different bands differ."""
    keys = np.zeros((len(samples), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(samples), band + 1, dtype=np.uint64)
        for r in range(rows):
            key = key * np.uint64(0xD6E8FEB86659FD93) + samples[:, band * rows + r]
        keys[:, band] = mix(key)
    return keys.view(np.int64)


def batched(items: Iterable, size: int) -> Iterator[list]:
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
