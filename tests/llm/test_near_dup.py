import random
import re

from leadloom.llm.near_dup import near_duplicates


def brute(rows, width=4, percent=80):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def planted(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "solo")]
    for i in range(6, 6 + n):
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    for i in range(6 + n, 6 + n + 30):
        rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 80)))))
    rows += [(1000 + i, rows[6 + i][1].replace(" ", "\n")) for i in range(20)]
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, label string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t"), (None, "a b c d e"), (None, "z y x w v")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 2, None, True)], key=str)


def test_blocks_find_links_that_stars_miss(spark, monkeypatch):
    import leadloom.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rows = planted(90, seed=11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """With the bound of a hot key at a few rows, every salted join is taken."""
    import leadloom.llm.joins as joins

    monkeypatch.setattr(joins, "HEAVY", 5)
    rows = planted(90, seed=21) + [(2000 + i, "same text for many rows of the table here") for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    few = spark.createDataFrame([(i, i % 3) for i in range(50)] + [(99, 7)], "v long, k long")
    counts = few.groupBy("k").count()
    one = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, name string")
    joined = joins.many_to_one(few, one, "k", joins.salts(counts, "k"), few["v"], "left").collect()
    assert sorted((r.v, r.k, r.name) for r in joined) == sorted([(i, i % 3, "abc"[i % 3]) for i in range(50)] + [(99, 7, None)])


def test_unlinked_classes_of_one_bucket_fetch_no_texts(spark):
    """10,000 classes in one bucket that are not alike: each meets every block, by its sketch, and none is marked."""
    import numpy as np

    from leadloom.llm import near_dup

    r = np.random.default_rng(4)
    n = 10_000
    sketches = r.integers(-(2**63), 2**63, (n, near_dup.BITS // 64), dtype=np.int64)
    sketches[1] = sketches[0]  # one likely pair
    bands = r.integers(-(2**63), 2**63, (n, near_dup.BANDS), dtype=np.int64)
    bands[:, 3] = 77
    keys = [int(i).to_bytes(16, "big") for i in range(n)]
    classes = spark.createDataFrame([(k, b, s) for k, b, s in zip(keys, bands.tolist(), sketches.tolist())], "key binary, bands array<long>, sketch array<long>")
    members = spark.createDataFrame([(77, k, k) for k in keys], "bucket long, key binary, label binary")
    spread = near_dup.dealt_blocks(members, near_dup.salts(members.groupBy("bucket").count(), "bucket")).cache()
    assert spread.count() <= n * (n / (near_dup.BLOCK * near_dup.SKETCHED) + 2)
    assert {bytes(x.key) for x in near_dup.likely_members(spread, classes, 80).collect()} == set(keys[:2])


def test_recall_at_the_threshold(spark):
    """500 pairs of a similarity just at or above 0.8: every one is linked."""
    r = random.Random(17)
    rows = []
    for i in range(500):
        n = r.randrange(60, 200)
        words = [f"p{i}w{j}" for j in range(n + 3)]  # n shingles
        other = list(words)
        keep = -(-8 * 2 * n // 18)  # of 2 n - s shingles s are shared: s / (2 n - s) >= 0.8
        for j in range(keep + 3, n + 3):
            other[j] = f"q{i}w{j}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(500))


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5003}x{i % 7}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "short")]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
