"""Operators 11 to 13 against brute force, with their odd cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import embedding_dup, merkle, near_dup, periodic_runs, queries

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# Periodic runs


def plain_runs(words, least):
    """Every period's maximal stretches; of those that are equal the one of the smallest period."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = period
        while i < len(words):
            if words[i] != words[i - period]:
                i += 1
                continue
            start = i - period
            while i < len(words) and words[i] == words[i - period]:
                i += 1
            if i - start >= 2 * period:
                found.setdefault((start, i - start), period)
    return sorted(((s, n, p) for (s, n), p in found.items() if n >= max(least, 2 * p)), key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_search():
    pick = random.Random(7)
    for _ in range(3000):
        words = [pick.randrange(pick.choice([1, 2, 3, 6])) for _ in range(pick.randrange(70))]
        if len(words) > 8 and pick.random() < 0.6:
            at = pick.randrange(len(words))
            period = pick.randint(1, max(1, (len(words) - at) // 2))
            words = words[:at] + [words[at + (i - at) % period] for i in range(at, len(words))]
        for least in (2, 7, 12):
            assert periodic_runs.runs(periodic_runs.word_numbers(words), least) == plain_runs(words, least)


def test_many_runs_take_near_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    found = periodic_runs.runs(np.array(b))
    assert len(found) > 5_000 and all(n >= max(12, 2 * p) for _, n, p in found)
    assert periodic_runs.runs(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]


def test_access_tells_last_ends():
    """Each suffix that ended before is in one segment, with the last word at which it ended."""
    words = [random.Random(3).randrange(2) for _ in range(40)]
    automaton = periodic_runs.SuffixAutomaton(words)
    tree = periodic_runs.LinkTree(automaton)
    for i, state in enumerate(automaton.prefix):
        told = {n: old for old, low, high in tree.access(state, i) for n in range(low + 1, high + 1)}
        for n in range(1, i + 2):
            ends = [e for e in range(n - 1, i) if words[e - n + 1 : e + 1] == words[i - n + 1 : i + 1]]
            assert told.get(n) == (ends[-1] if ends else None)


def test_query_equals_plain_words(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.periodic(spark, SF).collect()}
    compared = 0
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (row.text or "").encode().split()
        crc = zlib.crc32(str(row.doc_id).encode())
        if crc % 10 == 0 and words:
            a = crc // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + crc // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        if len(words) > 800:
            continue
        compared += 1
        found = plain_runs(words, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        dropped = {i for s, n, p in found for i in range(s + p, s + n)}
        texts = ("".join(f"{s},{n},{p}\n" for s, n, p in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x).hexdigest() for x in texts))
        assert got[row.doc_id] == want
    assert compared > 100 and len(got) == 200


def test_runs_of_odd_rows(spark):
    rows = [(1, None, "x", 1), (1, "", "x", 2), (2, " \t\n\x0b", None, 3), (3, "a b " * 6, "x", 4), (3, "a b " * 6, "x", 4), (4, "a b " * 12, "x", 5), (None, "na " * 11, "x", 6), (5, "w " * 30_000, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect())
    eleven = " ".join(["na"] * 11)
    assert got == [
        (0, [], eleven), (1, [], ""), (1, [], ""), (2, [], ""), (3, [(0, 12, 2)], "a b"), (3, [(0, 12, 2)], "a b"), (4, [(0, 12, 1)], "a b"), (5, [(0, 30_000, 1)], "w"),
    ]
    assert periodic_runs.find_runs(docs).columns == ["doc_id", "text", "runs", "collapsed"]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def plain_manifest(rows, changed):
    """Rows of the whole manifest, sorted; ``changed`` tells whether a row's leaf is recomputed with one character more."""
    leaf = lambda r: digest(*[told(r[c]) for c in FIELDS])
    parts = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in order:
        parts[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append(climb([leaf(r) for r in parts[name]]))
    top = climb([t[-1][0] for t in trees])
    made = []
    for k, name in enumerate(order):
        for i, r in enumerate(parts[name]):
            siblings, folded = [], leaf(r)
            if changed(r):
                folded = leaf(r | {"n_chars": None if r["n_chars"] is None else r["n_chars"] + 1})
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [x for j, x in enumerate(run) if j != at % 2]
                    run[at % 2] = folded
                    folded, at = digest(*run), at // 2
            made.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], digest(*siblings), folded, folded == top[-1][0]))
    return sorted(made, key=str)


def is_changed(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0


def test_manifest_equals_plain_trees(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.proofs(spark, SF).collect()), key=str)
    assert got == plain_manifest(rows, is_changed)
    assert sum(not r[-1] for r in got) == sum(map(is_changed, rows)) > 0


@pytest.mark.parametrize("span", [1, 3])
def test_manifest_of_several_rounds_and_odd_rows(spark, span):
    pick = random.Random(5)
    rows = [{"doc_id": i // 2 + 2**60 if i % 9 else None, "source": pick.choice([None, "", "s"]), "lang": pick.choice([None, "", "de", "é", "a", "a", "a"]), "n_chars": pick.choice([None, 3]), "text": pick.choice([None, "", "ü\n"])} for i in range(60)]
    rows += [dict(rows[0])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("part", "place", "nodes", "tree", "digest")})
    got = merkle.manifest(docs, list(FIELDS), tampered={"n_chars": F.col("n_chars") + 1}, where=queries.remainder(7) == 0, span=span)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows, is_changed)


def test_manifest_of_no_row_one_row_and_a_long_text(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema), list(FIELDS)).count() == 0
    row = {"doc_id": 1, "source": "s", "lang": "en", "n_chars": 5, "text": "x" * 3_000_000}
    got = merkle.manifest(spark.createDataFrame([tuple(row.values())], schema), list(FIELDS)).collect()
    assert [tuple(r) for r in got] == plain_manifest([row], lambda r: False)
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == digest()


# Near-duplicate vectors


def plain_links(rows, least=0.9):
    units = []
    for _, v in rows:
        fine = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if fine else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    made = []
    for i in range(n):
        reached, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        component = min(ids, default=None)
        made.append((rows[i][0], len(near[i]), component, rows[i][0] == component))
    return sorted(made, key=str)


def vectors(seed, n, dimensions=16):
    """Clusters of several widths, copies, chains and unrelated vectors."""
    random_ = np.random.default_rng(seed)
    centres = random_.standard_normal((6, dimensions))
    rows = []
    for i in range(n):
        kind = i % 6
        v = centres[kind] + random_.standard_normal(dimensions) * (0.0, 0.02, 0.2, 0.35, 0.5, 3.0)[kind]
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("ball", [8, 10_000])
def test_links_equal_all_pairs(spark, monkeypatch, ball):
    monkeypatch.setattr(embedding_dup, "BALL", ball)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = vectors(1, 400)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dup.near_vectors(table, miss=1e-6).collect()), key=str)
    assert got == plain_links(rows)
    assert max(r[1] for r in got) >= 66 and sum(r[3] for r in got) > 66


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.902, which hashing misses most easily."""
    random_ = np.random.default_rng(2)
    rows = []
    for i in range(500):
        a, b = random_.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.9001 + 0.0019 * random_.random()
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    got = embedding_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links >= 1").count() >= 0.99 * len(rows)


def test_vectors_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1e300, 0.0]), (9, [1e-300, -0.0]),
        (10, [1.0, 0.0, 0.0]), (None, [-1.0, 0.0]), (None, [-2.0, 0.1]), (None, [0.0, 3.0]), (None, None), (11, [0.9, math.sqrt(0.19)]),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, key int, label string").withColumns({c: F.lit(0) for c in ("id", "vector", "n_links", "size")})
    got = sorted((tuple(r) for r in embedding_dup.near_vectors(table, least=0.89).collect()), key=str)
    want = []
    for i, n, component, _ in plain_links([r for r in rows if r[1] is None or 1e300 not in r[1] and 1e-300 not in r[1]] + [(8, [1.0, 0.0]), (9, [1.0, 0.0])], 0.89):
        want.append((i, n, component, i == component or component is None))
    assert got == sorted(want, key=str)
    assert embedding_dup.near_vectors(table.limit(0)).count() == 0
    assert embedding_dup.near_vectors(table.where("embedding is null")).count() == 2
