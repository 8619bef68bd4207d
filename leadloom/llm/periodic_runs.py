"""Periodic runs of words: a suffix automaton with link-cut access.

The automaton of a stretch of words has one state for each class of substrings that end at
the same places; its suffix links form a tree, and the suffixes that end at a word are the
path from that prefix's state to the root.  Each word, in order, recolours its path with
its own number, so a node's colour is the last place at which its substrings ended.  The
path falls into segments of one old colour, as in the access of a link-cut tree.  A segment
holds the suffixes of more than ``low`` and at most ``high`` words, whose last end was
``e``: for a word at ``i`` with low < i - e <= high the last i - e words ended right before
themselves.  That is a square whose root is primitive, since a power would have occurred
later than e; it is extended to its run, the longest stretch of that period.

Segments are kept as one stack for each heavy path of the finished tree instead of in splay
trees: an access touches O(log n) heavy paths, and pops what it recolours.

A run has ``least`` words at least and twice its period, so it is covered by windows of
least // 2 words that occur in it twice.  Words that no repeated window covers are in no
run, and the automaton reads only stretches of covered words; this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

#: Words that a run has at least.
LEAST = 12

_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the place at which it first occurs."""
    return np.fromiter(map({}.setdefault, words, range(len(words))), np.int64, len(words))


def stretches(numbers: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """[start, end) of the stretches that windows of ``least // 2`` words, each there twice or more, cover."""
    width = max(1, least // 2)
    n = len(numbers)
    if n < least:
        return
    words, windows = numbers.astype(np.uint64), n - width + 1
    hashed = words[:windows].copy()
    for j in range(1, width):
        hashed = hashed * _MIX + words[j : j + windows]
    ordered = np.sort(hashed)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return
    starts = np.isin(hashed, again)
    change = np.zeros(n + 1, dtype=np.int64)
    change[:windows] += starts
    change[width : width + windows] -= starts
    covered = np.cumsum(change[:n]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end - start >= least:
            yield start, end


class SuffixAutomaton:
    """States by number, the root first: ``length`` of the longest substring, ``link``, and the state of each prefix."""

    def __init__(self, words: list[int]):
        self.link, self.length, self.prefix = link, length, prefix = [-1], [0], []
        moves: list[dict[int, int]] = [{}]
        last = 0
        for i, word in enumerate(words):
            state = len(length)
            moves.append({})
            length.append(i + 1)
            link.append(0)
            at = last
            while at != -1 and word not in moves[at]:
                moves[at][word] = state
                at = link[at]
            if at != -1:
                to = moves[at][word]
                if length[to] == length[at] + 1:
                    link[state] = to
                else:
                    clone = len(length)
                    moves.append(moves[to].copy())
                    length.append(length[at] + 1)
                    link.append(link[to])
                    link[to] = link[state] = clone
                    while at != -1 and moves[at].get(word) == to:
                        moves[at][word] = clone
                        at = link[at]
            prefix.append(state)
            last = state


class LinkTree:
    """The suffix links with their heavy paths: ``access`` recolours a path to the root and tells its segments."""

    def __init__(self, automaton: SuffixAutomaton):
        link, length = automaton.link, automaton.length
        n = len(length)
        downward = np.argsort(np.array(length), kind="stable").tolist()
        size, heavy = [1] * n, [-1] * n
        for v in reversed(downward[1:]):
            size[link[v]] += size[v]
        most = [0] * n
        for v in downward[1:]:
            up = link[v]
            if size[v] > most[up]:
                most[up], heavy[up] = size[v], v
        #: Of each state: its heavy path and its place there; of each path: lengths along it, the link above, its segments.
        self.path, self.place = [0] * n, [0] * n
        self.lengths: list[list[int]] = []
        self.above: list[int] = []
        self.segments: list[list[tuple[int, int]]] = []
        for v in downward:
            up = link[v]
            if up != -1 and heavy[up] == v:
                p = self.path[up]
            else:
                p = len(self.lengths)
                self.lengths.append([])
                self.above.append(up)
                self.segments.append([])
            self.path[v] = p
            self.place[v] = len(self.lengths[p])
            self.lengths[p].append(length[v])
        self.length = length

    def access(self, v: int, colour: int) -> list[tuple[int, int, int]]:
        """Colour the path from ``v`` to the root; (old colour, low, high) of its segments, lengths in (low, high]."""
        told = []
        while v > 0:
            p, at = self.path[v], self.place[v]
            # The last segment is nearest to the top of its path; (last place of the segment, its colour).
            stack, lengths = self.segments[p], self.lengths[p]
            up = self.above[p]
            low = self.length[up] if up >= 0 else 0
            while stack and stack[-1][0] <= at:
                end, old = stack.pop()
                told.append((old, low, lengths[end]))
                low = lengths[end]
            if stack and low < lengths[at]:
                told.append((stack[-1][1], low, lengths[at]))
            stack.append((at, colour))
            v = up
        return told


def runs_of(words: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs, in the order in which their first squares end."""
    automaton = SuffixAutomaton(words)
    tree = LinkTree(automaton)
    found: list[Run] = []
    reached: dict[int, int] = {}  # period -> last word of its last run
    n = len(words)
    for i, state in enumerate(automaton.prefix):
        for old, low, high in tree.access(state, i):
            period = i - old
            if low < period <= high and reached.get(period, -1) < i:
                end = i + 1
                while end < n and words[end] == words[end - period]:
                    end += 1
                start = i - 2 * period + 1
                while start > 0 and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                reached[period] = end - 1
                if end - start >= least:
                    found.append((start, end - start, period))
    return found


def runs(numbers: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    found = []
    for start, end in stretches(numbers, least):
        found += [(start + s, length, period) for s, length, period in runs_of(numbers[start:end].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, dropped in zip(words, np.cumsum(change[:-1]).tolist()) if not dropped]


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of ``docs``, ``runs`` and ``collapsed``.

    Words are what stands between ASCII white space.  ``runs`` has start (word number from
    0), length and period in words of each run of ``least`` words or more and of twice its
    smallest period, by start, then period.  ``collapsed`` has the words that no run holds
    beyond its first period, joined by one blank.  Null, empty and blank texts have no runs
    and an empty collapsed text; repeated rows are treated alike, each on its own.  Columns
    that have these two names are replaced.
    """
    others = docs.drop("runs", "collapsed")
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType([*others.schema.fields, StructField("__words", BinaryType()), StructField("runs", ArrayType(run)), StructField("collapsed", BinaryType())])
    names = [f.name for f in schema]
    spans = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found, texts = [], []
                for text in part.column(part.num_columns - 1):
                    words = (text.as_py() or b"").split()
                    own = runs(word_numbers(words), least)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    texts.append(b" ".join(collapse(words, own)))
                blank = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], blank, pa.array(found, spans), pa.array(texts, pa.binary())], names=names)

    marked = others.withColumn("__words", F.col(text_col).cast("string").cast("binary")).mapInArrow(add, schema)
    return marked.select(*[marked[c] for c in others.columns], "runs", F.col("collapsed").cast("string").alias("collapsed"))


def longest(found: Column) -> Column:
    """The run of the greatest length, then the smallest start, then the smallest period; null where there is none."""
    ranked = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(ranked.isNotNull(), F.struct((-ranked["start"]).alias("start"), ranked["length"].alias("length"), (-ranked["period"]).alias("period")))


def as_text(found: Column) -> Column:
    """One line for each run: start,length,period."""
    return F.concat_ws("", F.transform(found, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
