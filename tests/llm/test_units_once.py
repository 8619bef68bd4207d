"""Units of a large vocabulary are encoded about once each, whole texts of any length too."""

import random

import pytest

from leadloom.llm import tokens

paths = pytest.importorskip("public_tokenizers")


class Counted:
    """An encoder that counts the characters that it is given."""

    def __init__(self, fast):
        self.fast, self.chars = fast, 0

    def encode_ordinary(self, text):
        self.chars += len(text)
        return self.fast.encode_ordinary(text)


def words(r, n):
    return ["".join(r.choice("abcdefghijé.") for _ in range(12)) for _ in range(n)]


def test_a_large_vocabulary_is_encoded_about_once():
    r = random.Random(3)
    own = tokens.ByteLevelEncoder(paths.path("byte_bpe_50k.json"))
    own.fast = counted = Counted(own.fast)
    known = words(r, 120_000)
    for _ in range(4):
        r.shuffle(known)
        own.many([" ".join(known[k : k + 400]) for k in range(0, len(known), 400)])
    assert counted.chars < 1.5 * 13 * len(known)


def test_a_text_longer_than_a_part(monkeypatch):
    monkeypatch.setattr(tokens, "_PART_CHARS", 5_000)
    path, r = paths.path("byte_bpe_50k.json"), random.Random(5)
    own, library = tokens.ByteLevelEncoder(path), tokens.load(path)
    known = words(r, 900)
    texts = ["\n".join(" ".join(r.choices(known, k=40)) for _ in range(60)), "é" * 12_000, "a\nb", " ", "", " ".join(r.choices(known, k=3_000)), "日本 語。\n'll 's"]
    assert own.many(texts) == [tokens.ids_bytes(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_long_unit_is_not_kept():
    own = tokens.ByteLevelEncoder(paths.path("byte_bpe_50k.json"))
    first, again = own.many(["a b " + "c" * 3_000_000 + " d", "a b"]), own.many(["a b " + "c" * 3_000_000 + " d", "a b"])
    assert first == again and own.units.nbytes + own.ids.nbytes < 1_000
