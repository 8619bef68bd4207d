"""Quality, toxicity, line dedup, fingerprints and the pipeline: held-out accuracy and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import fingerprints, line_dedup, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_quality_is_right_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    got = [r for r in queries.quality_scores(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 50 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.95


def test_pairwise_fit_is_the_optimum():
    """At the weights found, the gradient of the pairs' logistic loss is nil, and a plain descent ends at the same order."""
    r = np.random.default_rng(1)
    rows = r.normal(size=(400, len(quality.FEATURES)))
    labels = (rows[:, 0] + 0.5 * rows[:, 3] + r.normal(scale=0.7, size=400) > 0).astype(int)
    model = quality.fit_pairs(rows, labels, pairs=4000, rounds=1500, penalty=1e-2)
    x = np.clip((rows - rows.mean(axis=0)) / (rows.std(axis=0) + 1e-3), -6, 6)
    again = np.random.default_rng(5)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    d = x[again.choice(good, 4000)] - x[again.choice(bad, 4000)]
    gradient = lambda w: (1 / (1 + np.exp(d @ w))) @ d / 4000 - 1e-2 * w
    assert np.abs(gradient(np.array(model.weights))).max() < 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(6000):
        w = w + 0.1 * gradient(w)
    assert np.abs(w - model.weights).max() < 0.02
    # The score of 0.5 is the quantile of the rejected share.
    assert abs((model.score(rows) < 0.5).mean() - (labels == 0).mean()) <= 1 / 400 + 1e-9


def test_quality_training_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} " * (i % 9)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id long, quality int")
    seen = []
    found = quality.fit_pairs
    quality.fit_pairs = lambda rows, y: seen.append(len(rows)) or found(rows, y, pairs=50, rounds=5)
    try:
        quality.train(docs, labels, F.lit(True), max_labelled=30)
        quality.train(docs.limit(0), labels, F.lit(True))
        quality.train(docs, labels.limit(0), F.lit(True))
    finally:
        quality.fit_pairs = found
    assert seen == [30, 0, 0]


def test_toxicity_is_right_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    got = [r for r in queries.toxicity_scores(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.9


def test_pairs_order_documents():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 400)
    x = r.normal(size=(400, len(quality.FEATURES)))
    x[:, 3] += 3 * y
    model = quality.fit_pairs(x, y)
    s = model.score(x)
    assert s[y == 1].mean() > 0.6 > 0.4 > s[y == 0].mean()
    assert set(quality.fit_pairs(x, np.ones(400)).score(x)) == {0.5}


def test_odd_texts_have_scores(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x" * 100_000, "a"), (None, " \n", "a"), (1, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = quality.fit_pairs(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert [r.score for r in quality.score(df, model).collect()] == [0.5] * 5
    assert quality.score(df.limit(0), model).count() == 0
    field = toxicity.fit(["a b", "c d"], np.array([0, 0]))
    out = toxicity.tag_documents(df, field).collect()
    assert all(0 <= r.toxicity <= 1 and r.toxic_spans == [] for r in out)
    assert toxicity.tag_documents(df.limit(0), field).count() == 0


def _brute_marginals(model, odds):
    """Sums over all state sequences."""
    import itertools

    up, down, stay = np.exp(model.moves)
    move = {(0, 0): 1.0, (0, 1): up, (1, 0): down, (1, 1): stay}
    total, ones = 0.0, np.zeros(len(odds))
    for states in itertools.product((0, 1), repeat=len(odds)):
        w = np.exp(model.start) if states[0] else 1.0
        for t, s in enumerate(states):
            w *= odds[t] if s else 1.0
            w *= move[states[t - 1], s] if t else 1.0
        total += w
        ones += w * np.array(states)
    return ones / total


def test_forward_backward_equals_enumeration():
    model = toxicity.ToxicityModel({}, -1.0, 0.3, (-0.5, 0.2, 0.9), 1.0, 0.0)
    chains = [[0.5], [2.0, 0.1, 3.0], [0.3] * 8, [1.5, 0.2, 0.2, 4.0, 0.7]]
    for chain, odds in zip(model._solve(chains), chains):
        assert np.allclose(chain.probability, _brute_marginals(model, odds))


def test_spans_are_where_the_words_are(spark):
    r = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    docs, labels = [], []
    for _ in range(300):
        text = [r.choice(words) for _ in range(40)]
        bad = r.random() < 0.4
        if bad:
            text[r.randrange(40)] = "grobian" + r.choice(["a", "e", "us"])
        docs.append(" ".join(text))
        labels.append(int(bad))
    model = toxicity.fit(docs, np.array(labels))
    df = spark.createDataFrame([(0, "wax fine\n\n wex grobianum, wix")], "doc_id long, text string")
    row = toxicity.tag_documents(df, model).first()
    assert row.toxicity > 0.5
    (span,) = row.toxic_spans
    assert "wax fine\n\n wex grobianum, wix"[span.start : span.end] == "grobianum,"


def _brute_lines(rows, ratio, least):
    total = Counter(h for _, h, _ in rows)
    seen = Counter((h, x) for _, h, t in rows for x in {y.strip(" ") for y in (t or "").split("\n")} if x)
    drop = {k for k, n in seen.items() if n / total[k[0]] > ratio and n >= least}
    out = []
    for i, h, t in rows:
        lines = None if t is None else t.split("\n")
        kept = None if t is None else [x for x in lines if (h, x.strip(" ")) not in drop]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(lines) - len(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        host = r.choice(["a", "a", "a", "b", "c", None])
        lines = [f"line {r.randrange(400)}" for _ in range(r.randrange(0, 9))]
        if r.random() < 0.3:
            lines.insert(0, " boiler ")
        if r.random() < 0.1:
            lines += ["", "boiler", "boiler"]
        rows.append((i if i % 50 else None, host, "\n".join(lines) if i % 37 else None))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_dedup.drop_boilerplate(df, ratio=0.05).collect()
    assert sorted(((x.doc_id, x.text, x.dropped_lines) for x in got), key=str) == sorted(_brute_lines(rows, 0.05, 2), key=str)
    assert sum(x.dropped_lines for x in got) > 20
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_by_shuffle_equals_brute_force(spark, monkeypatch):
    """Beyond the bound of a broadcast: hosts with the most pages, hosts without any line to drop, null hosts and clashing names."""
    r = random.Random(8)
    rows = []
    for i in range(900):
        host = r.choice(["hot"] * 6 + ["plain"] * 3 + [f"h{r.randrange(60)}", None])
        lines = [f"line {i} {r.random()}" for _ in range(3)] if host == "plain" else [f"{host} {r.randrange(30)}" for _ in range(r.randrange(0, 6))]
        rows.append((i, host, "\n".join(lines)))
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, source string, text string, kept_chars int")
    for bound in (0, 60, 150):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
        got = line_dedup.drop_boilerplate(df, ratio=0.05).collect()
        assert sorted(((x.doc_id, x.text, x.dropped_lines) for x in got), key=str) == sorted(_brute_lines(rows, 0.05, 2), key=str)


def test_lines_of_a_small_host_go(spark):
    """Four pages that all have one line: no number of pages is needed but two."""
    rows = [(i, "h", f"own {i}\nmenu") for i in range(4)] + [(9, "alone", "only\nonly")]
    got = {x.doc_id: x.text for x in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {0: "own 0", 1: "own 1", 2: "own 2", 3: "own 3", 9: "only\nonly"}


def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op9_line_dedup"])
    at = [want.columns.index(c) for c in ("doc_id", "dropped_lines", "kept_chars", "text_md5")]
    assert sorted(tuple(r[i] for i in at) for r in want.fetchall()) == sorted(map(tuple, queries.lines(spark, SF).collect()))


def _shingles(text, k=5):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints(spark):
    r = random.Random(8)
    texts = ["", "one", "one two three four five six"] + [" ".join(f"w{r.randrange(60)}é" for _ in range(r.randrange(1, 400))) for _ in range(60)]
    ids = r.sample(range(1000), len(texts))
    df = spark.createDataFrame([*zip(ids, texts), (None, "no id here at all x")], "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(df).collect()}
    order = sorted(zip(ids, texts))
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        row = got[i]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = _shingles(t), _shingles(edited), _shingles(following)
        for value, x in ((row.near_edited, b), (row.near_next, c)):
            want = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(value - want) < (1e-9 if len(a | x) <= fingerprints.K else 0.25)
        assert row.shingles == len(a) if len(a) < fingerprints.K else abs(row.shingles / len(a) - 1) < 0.4
    assert got[None].near_next is None and len(got) == len(texts) + 1
    assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0


def _print(text, k=fingerprints.K):
    """The fingerprint string by plain Python: nested 64-bit hashes of the words and of each five of them."""
    def chained(parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x, seed)
        return seed

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    found = {chained([h.to_bytes(8, "little") for h in words[i : i + 5]]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else set()
    if 0 < len(words) < 5:
        return None  # shorter sequences are padded with nulls, which hash as nothing
    signed = sorted(h - 2**64 if h >= 2**63 else h for h in found)[:k]
    return "".join(f"{h & (2**64 - 1):016x}" for h in signed)


def test_fingerprint_strings(spark):
    r = random.Random(18)
    texts = ["", "a b c d e", "A b  c d e\nf", *(" ".join(f"w{r.randrange(90)}é" for _ in range(r.randrange(5, 900))) for _ in range(30)), " ".join(f"v{i % 4099}" for i in range(200_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].fingerprint == _print(t)
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want = _print(edited)
        assert want is None or got[i].edited_fingerprint == want


def test_repeated_ids_have_one_next(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "zz"), (2, "c d"), (3, "e f")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.text, r.next.text) for r in got) == sorted([(1, "a b", "c d"), (1, "a b", "c d"), (2, "zz", "e f"), (2, "c d", "e f"), (3, "e f", "a b")])


def test_fingerprints_merge(spark):
    parts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 300), (200, 500))]
    df = spark.createDataFrame([tuple(parts)], "a string, b string")
    f = lambda c: fingerprints.fingerprint(F.col(c))
    union = fingerprints.bottom_k(F.array_union(fingerprints.shingle_hashes(F.col("a")), fingerprints.shingle_hashes(F.col("b"))))
    row = df.select((fingerprints.merge(f("a"), f("b")) == union).alias("same"), fingerprints.resemblance(f("a"), f("b")).alias("r"), fingerprints.containment(f("a"), f("b")).alias("c")).first()
    assert row.same and abs(row.r - 96 / 496) < 0.12 and abs(row.c - 96 / 296) < 0.2


def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_near_dup import brute

    docs = queries.table(spark, SF, "documents").limit(250).cache()
    labels = {r.doc_id: (r.quality, r.toxic) for r in queries.table(spark, SF, "labels").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_dup", "packing"]
    good = steps["quality"](spark, docs, SF).cache()
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    judged = [(r.doc_id in ids, labels[r.doc_id][0] == 1) for r in docs.collect() if r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) > 0.95
    calm = steps["toxicity"](spark, good, SF).cache()
    assert calm.columns == docs.columns and {r.doc_id for r in calm.collect()} <= ids
    lines = steps["line_dedup"](spark, calm, SF).cache()
    assert lines.columns == docs.columns and all(len(r.text) == r.n_chars for r in lines.collect()) and lines.count() == calm.count()
    one = steps["near_dup"](spark, lines, SF)
    want = brute([(r.doc_id, r.text) for r in lines.collect()], width=5)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, _, kept) in want.items() if kept}
    packed = steps["packing"](spark, one, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in one.collect()}
