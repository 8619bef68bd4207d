"""What a Python worker holds doesn't grow with its texts."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructType

from leadloom.llm import quality, tokens

paths = pytest.importorskip("public_tokenizers")


def held_and_peak_mb(work):
    tracemalloc.start()
    work()
    found = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return [n / 1e6 for n in found]


def test_units_met_are_not_all_kept():
    own = tokens.ByteLevelEncoder(paths.path("byte_bpe_50k.json"))
    own.many(["warm up"])
    calls = [[f"l{k}\n" + " ".join(f"w{k + 300 * j}x" for j in range(1000)) for k in range(at, at + 100)] for at in range(0, 300, 100)]
    assert held_and_peak_mb(lambda: [len(own.many(texts)) for texts in calls])[0] < 25
    own = tokens.ByteLevelEncoder(paths.path("byte_bpe_50k.json"))
    long = [f"a{k} " + f"b{k}" * 20_000 for k in range(100)]  # long units
    assert held_and_peak_mb(lambda: [len(own.many([t])) for t in long])[0] < 10


@pytest.mark.parametrize("chars", [1, 60, 2_000])
def test_units_that_went_are_encoded_again(monkeypatch, chars):
    path = paths.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "_UNIT_CHARS", chars, raising=False)
    monkeypatch.setattr(tokens, "_PART_CHARS", 2 * chars, raising=False)
    own, library, r = tokens.ByteLevelEncoder(path), tokens.load(path), random.Random(chars)
    words = ["".join(r.choice("abcdé日'.1") for _ in range(r.randrange(1, 8))) for _ in range(200)]
    texts = ["\n".join(" ".join(r.choices(words, k=r.randrange(1, 20))) for _ in range(r.randrange(1, 5))) for _ in range(150)] + ["", "a  b"]
    for _ in range(2):
        assert own.many(texts) == [tokens.ids_bytes(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.many([]) == []


class Rows:
    """Hands over what is given to mapInArrow."""

    columns, schema = ["doc_id", "text"], StructType().add("doc_id", LongType()).add("text", StringType())

    def drop(self, *names):
        return self

    def mapInArrow(self, work, schema):
        return work


def test_a_large_batch_is_scored_in_parts():
    n = len(quality.FEATURES)
    add = quality.score(Rows(), quality.QualityModel((0.0,) * n, (1.0,) * n, (0.1,) * n, 0.0, 1.0))
    texts = [f"text {i} " + "a" * 5_000 for i in range(6_000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = []
    assert held_and_peak_mb(lambda: got.extend(x.column(2).to_numpy() for x in add(iter([batch]))))[1] < 20
    scores = [x for part in got for x in part]
    assert len(scores) == len(texts) and scores[7] == scores[8] and scores[-1] != scores[7]
    assert not list(add(iter([batch.slice(0, 0)])))
