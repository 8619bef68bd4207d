"""Token ids and decoded texts by the tokenizers library, with reuse inside a worker.

Both encoders give exactly what ``Tokenizer.encode(text, add_special_tokens=False)``
gives for the whole text; tests compare them.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker keeps units of so many bytes; where new ones have no room, those of the block met last replace them.
_UNIT_CHARS = 2_000_000
#: Texts are encoded in parts of so many characters; a longer text is read in blocks of so many bytes.
_PART_CHARS = 2_000_000


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    data = array("I", ids)
    if data.itemsize != 4 or os.sys.byteorder != "little":
        import struct

        return struct.pack(f"<{len(ids)}I", *ids)
    return data.tobytes()


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = [""] * 256, 256
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b], free = chr(free), free + 1
    return table


def byte_letters(text: str) -> str:
    """A text as a byte-level vocabulary spells it."""
    letters = _byte_letters()
    return "".join([letters[b] for b in text.encode("utf-8")])


#: The pre-tokenisation pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = ("<|", "  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _binary(offsets: np.ndarray, data) -> pa.LargeBinaryArray:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _parts_of(values: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """The offsets of an array without nulls, and the data that they point into."""
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1], memoryview(data if data is not None else b"")


def _size(values: pa.LargeBinaryArray) -> int:
    offsets = _parts_of(values)[0]
    return int(offsets[-1] - offsets[0])


class ByteLevelEncoder:
    """Encoder for byte-level vocabularies whose pieces are a space and a word at most.

    A piece boundary lies before every single space between two visible characters and
    on both sides of a single line feed between two, so such texts fall into units, each
    with the space or line feed before it.  The units of a block are numbered by Arrow, and
    each is encoded once a block, or not at all while it is kept.  Texts with other white
    space or special tokens go whole to the tokenizer.  New units are encoded many in one
    call by a faster library with the same vocabulary; each id's length in bytes tells
    which unit it is of.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        bytes_of = {letter: b for b, letter in enumerate(_byte_letters())}
        ranks = {bytes([bytes_of[c] for c in w]): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in special}
        self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(1 + max(ranks.values()), dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        #: The units that are kept, and the ids of each as bytes.
        self.units, self.ids = _binary(np.zeros(1, np.int64), b""), _binary(np.zeros(1, np.int64), b"")

    def _learn(self, units: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of units, encoded many in one call."""
        raw, ends = [], [np.zeros(1, np.int64)]
        done = 0
        for at in range(0, len(units), 20_000):
            starts, data = _parts_of(units[at : at + 20_000])
            ids = np.array(self.fast.encode_ordinary(bytes(data[starts[0] : starts[-1]]).decode()), dtype="<u4")
            raw.append(ids.tobytes())
            ends.append(done + 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), starts[1:] - starts[0]) + 1))
            done += len(raw[-1])
        return _binary(np.concatenate(ends), b"".join(raw))

    def _of_units(self, units: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each unit; repeated ones are looked up once."""
        numbered = units.dictionary_encode()
        distinct = numbered.dictionary
        kept = pc.index_in(distinct, value_set=self.units)
        new = distinct.filter(kept.is_null())
        at = kept.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.units) + np.arange(len(new))
        every = pa.concat_arrays([self.ids, self._learn(new)])
        ids = every.take(pa.array(at))
        if _size(self.units) + _size(new) <= _UNIT_CHARS:
            self.units, self.ids = pa.concat_arrays([self.units, new]), every
        elif _size(distinct) <= _UNIT_CHARS:
            self.units, self.ids = distinct, ids
        return ids.take(numbered.indices)

    def many(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= _PART_CHARS:
                size += len(texts[end])
                end += 1
            out += self._part(texts[at:end])
            pa.default_memory_pool().release_unused()  # or Arrow holds on to a part's memory beside that of the ids
            at = end
        return out

    def _part(self, texts: Sequence[str]) -> list[bytes]:
        """A line feed is put before each text and its one id taken off again, so that every unit has a lead."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for k, text in enumerate(texts):
            odd = not text or text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, _ODD))
            if not odd and (text.isascii() or not _WIDE_SPACE.search(text)):
                plain.append(k)
            elif text:
                out[k] = ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not plain:
            return out
        coded = [b"\n" + texts[k].encode("utf-8") for k in plain]
        starts = np.cumsum([0, *map(len, coded)])
        data = b"".join(coded)
        del coded
        raw: list[memoryview] = []
        bounds: list[np.ndarray] = []
        at = done = 0
        while at < len(data):
            end = data.find(b" ", at + _PART_CHARS)
            end = end if end > 0 else len(data)
            block = np.frombuffer(data, np.uint8, end - at, at)
            leads = np.flatnonzero((block == 32) | (block == 10))
            ends, ids = _parts_of(self._of_units(_binary(np.append(leads, len(block)), block)))
            inside = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at
            bounds.append(done + ends[np.searchsorted(leads, inside)])
            raw.append(ids)
            done += int(ends[-1])
            at = end
        joined = raw[0] if len(raw) == 1 else memoryview(b"".join(raw))
        places = [*np.concatenate(bounds).tolist(), done]
        for k, first, last in zip(plain, places, places[1:]):
            out[k] = bytes(joined[first + 4 : last])
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelEncoder:
    """One encoder per worker, so that later tasks reuse its units."""
    return ByteLevelEncoder(path)
