"""BPE encoding and decoding by content-defined chunks.

A rolling hash over the last bytes cuts texts where their content says so; equal
passages give equal chunks whatever stands before them.  A chunk is encoded and decoded
once per worker and reused in all documents that share it.  Each join of two chunks is
then repaired: a window around the cut is encoded anew, and agrees if its ids begin and
end with the ids that the chunks have there.  A window that doesn't agree grows, at last
to the whole text, so what comes out is what the tokenizer gives for the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_letters, ids_bytes, load

#: A cut comes after about 2 ** CUT_BITS bytes, by the hash of the last WINDOW bytes (a power of two).
CUT_BITS, WINDOW = 10, 16
_CHUNKS, _UNITS = 20_000, 600_000
#: Units (or tokens) of either chunk with which a window begins.
CONTEXT = 2
#: Marks of white space in vocabularies that have it in their tokens.
_SPACE_MARKS = re.compile("[\\s\u0120\u010a\u2581]")
_BASE, _MIX = 0x9E3779B1, 0x85EBCA6B
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cuts(data: bytes, bits: int = CUT_BITS) -> list[int]:
    """Offsets in ``data`` at which chunks end, by content alone, never inside a character."""
    if len(data) <= WINDOW:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    rolled, width, base = raw.astype(np.uint32), 1, _BASE
    while width < WINDOW:  # the hash of 2n bytes from those of its two halves
        rolled = rolled[:-width] * np.uint32(base) + rolled[width:]
        width, base = 2 * width, base * base % 2**32
    found = np.flatnonzero((rolled * np.uint32(_MIX)) < np.uint32(2 ** (32 - bits))) + WINDOW
    found = found[found < len(raw)]
    return found[(raw[found] & 0xC0) != 0x80].tolist()


class _Words(dict):
    """Characters between white space -> ids; ``decoded`` has their decoded texts."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.decoded = tokenizer, {}

    def __missing__(self, unit: str) -> bytes:
        last = unit[-1:]
        if last and last in ",." and unit[:-1].isalpha():
            ids = self[unit[:-1]] + self[last]
            decoded = f"{self.decoded[unit[:-1]]} {self.decoded[last]}"
        else:
            plain = self.tokenizer.normalizer.normalize_str(unit)
            if plain != unit and plain.isalpha():
                ids = self[plain]
                decoded = self.decoded[plain]
            elif plain.isalpha():
                tokens = self.tokenizer.model.tokenize(byte_letters(plain))
                ids, decoded = ids_bytes([t.id for t in tokens]), " ".join([t.value for t in tokens])
            else:
                found = self.tokenizer.encode(unit, add_special_tokens=False).ids
                ids, decoded = ids_bytes(found), self.tokenizer.decode(found, skip_special_tokens=False)
        self[unit], self.decoded[unit] = ids, decoded
        return ids


def tokens_stand_apart(tokenizer) -> bool:
    """Whether words end in the vocabulary and no token joins white space to anything, so that units are encoded by themselves."""
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    tokens = (t.removesuffix(suffix or "") for t in tokenizer.get_vocab(with_added_tokens=True))
    return bool(suffix) and not any(len(t) > 1 and _SPACE_MARKS.search(t) for t in tokens)


class ChunkedEncoder:
    """Ids and decoded texts, equal to the tokenizer's for the whole text.

    Where the vocabulary's tokens stand apart, chunks are put together from the units
    between white space; otherwise the tokenizer encodes each chunk.
    """

    def __init__(self, path: str, bits: int = CUT_BITS):
        self.tokenizer = load(path)
        self.bits = bits
        self.words = _Words(self.tokenizer)
        self.apart = tokens_stand_apart(self.tokenizer)
        self.chunks: dict[bytes, tuple | None] = {}
        self.reused = self.encoded = self.grown = 0

    def _units(self, text: str) -> tuple[bytes, str]:
        units = text.replace("\n", " ").split(" ")
        if len(self.words) > _UNITS:
            self.words.clear()
            self.words.decoded.clear()
        ids = b"".join(map(self.words.__getitem__, units))
        return ids, " ".join(filter(None, map(self.words.decoded.__getitem__, units)))

    def _whole(self, text: str) -> tuple[bytes, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids_bytes(ids), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _cached(self, data: bytes, make) -> tuple | None:
        if data in self.chunks:
            self.reused += 1
            return self.chunks[data]
        self.encoded += 1
        value = make(data.decode("utf-8", "surrogatepass"))
        if len(self.chunks) > _CHUNKS:
            self.chunks.clear()
        self.chunks[data] = value
        return value

    def _inside(self, text: str) -> tuple[str, int, int, bytes, str] | None:
        """A chunk's text, its first and last white space, and what is encoded and decoded between; None without two."""
        plain = text.replace("\n", " ")
        first, last = plain.find(" "), plain.rfind(" ")
        return (text, first, last, *self._units(text[first : last + 1])) if 0 <= first < last else None

    def _joined(self, left: tuple | None, between: str, right: tuple | None) -> bytes | None:
        """The ids from the last white space in ``left`` to the first in ``right``, after agreement; None without any."""
        k = CONTEXT
        while True:
            before = after = ""
            known = left_ids = right_ids = b""
            full = True
            if left is not None:
                text, first, last = left[:3]
                units = text[first + 1 : last].replace("\n", " ").rsplit(" ", k)
                full = len(units) <= k
                units = units[-k:]
                before, left_ids = text[last - len(" ".join(units)) :], b"".join(map(self.words.__getitem__, units))
            if right is not None:
                text, first, last = right[:3]
                units = text[first + 1 : last].replace("\n", " ").split(" ", k)
                full = full and len(units) <= k
                units = units[:k]
                after, right_ids = text[: first + 1 + len(" ".join(units))], b"".join(map(self.words.__getitem__, units))
            known = ids_bytes(self.tokenizer.encode(before + between + after, add_special_tokens=False).ids)
            if len(known) >= len(left_ids) + len(right_ids) and known.startswith(left_ids) and known.endswith(right_ids):
                return known[len(left_ids) : len(known) - len(right_ids)]
            self.grown += 1
            if full:
                return None
            k *= 2

    def __call__(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as bytes, and its decoded text."""
        data = text.encode("utf-8", "surrogatepass")
        ends = cuts(data, self.bits)
        if not self.apart:
            return self._by_tokens(text, data, ends)
        if not ends:
            return self._units(text)
        ids: list[bytes] = []
        decoded: list[str] = []
        left, between, at = None, "", 0
        for end in [*ends, len(data), None]:
            right = None
            if end is not None:
                piece = data[at:end]
                right, at = self._cached(piece, self._inside), end
                if right is None:  # no inside: the window reaches into the next chunk
                    between += piece.decode("utf-8", "surrogatepass")
                    continue
            joined = self._joined(left, between, right)
            if joined is None:
                return self._whole(text)
            if joined:
                ids.append(joined)
                decoded.append(self.tokenizer.decode(np.frombuffer(joined, dtype="<u4").tolist(), skip_special_tokens=False))
            if right is not None and right[3]:
                ids.append(right[3])
                decoded.append(right[4])
            left, between = right, ""
        return b"".join(ids), " ".join(decoded)

    def _tokens(self, text: str) -> tuple[str, list[int], list[int]]:
        """A chunk's text, ids, and where each token ends."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return text, found.ids, [b for _, b in found.offsets]

    def _by_tokens(self, text: str, data: bytes, ends: list[int]) -> tuple[bytes, str]:
        """For any vocabulary: windows begin and end between tokens of the chunks."""
        least = 64  # bytes of a chunk, so that it has some tokens
        kept: list[int] = []
        for end in ends:
            if end - (kept[-1] if kept else 0) >= least and len(data) - end >= least:
                kept.append(end)
        ids: list[int] = []
        left, used, at = None, 0, 0
        for end in [*kept, len(data)]:
            right = self._cached(data[at:end], self._tokens)
            at, skip = end, 0
            if left is not None:
                k = 2 * CONTEXT
                while True:
                    if len(left[1]) - used < 2 * k or len(right[1]) < 2 * k:
                        return self._whole(text)
                    window = left[0][left[2][-2 * k - 1] if len(left[2]) > 2 * k else 0 :] + right[0][: right[2][2 * k - 1]]
                    found = self.tokenizer.encode(window, add_special_tokens=False).ids
                    if len(found) >= 2 * k and found[:k] == left[1][-2 * k : -k] and found[-k:] == right[1][k : 2 * k]:
                        break
                    self.grown += 1
                    k *= 2
                ids += left[1][used : len(left[1]) - k] + found[k : len(found) - k]
                skip = k
            left, used = right, skip
        ids += left[1][used:]
        return ids_bytes(ids), self.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def chunked(path: str) -> ChunkedEncoder:
    """One encoder per worker, so that later tasks reuse its chunks."""
    return ChunkedEncoder(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text of each document.

    With ``with_ids`` also ``ids`` (array of int) and ``decoded``.  A null text is an
    empty one: no ids, an empty decoded text.  Repeated rows and null ids stay as they
    are; other columns are not read.
    """
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunked(tokenizer)
        for batch in batches:
            counts, first, second, all_ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, decoded = encoder(text or "")
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
