"""Exact folding of texts in any alphabet, and the way back from a folded text to its source.

The functions of ``functions.text`` fold known alphabets in generated code.  Where the
alphabet is open, marks go by the characters' decomposition, which Spark has no function
for: these are vectorised functions over Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


@lru_cache(maxsize=100_000)
def _fold_letter(letter: str) -> str:
    """What a character folds to: nothing for a mark, several letters for some."""
    return "".join(x for x in unicodedata.normalize("NFD", letter) if unicodedata.category(x) != "Mn").lower()


def fold_text(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_fold_letter, text))


def find_in_source(text: str, wanted: str) -> tuple[int, int] | None:
    """Start and length in ``text`` of the first place whose folded form is that of ``wanted``.

    The place begins at the character that gives the first folded letter and ends before
    the next character that gives any, so marks stay with their letters.
    """
    wanted = fold_text(wanted)
    at = fold_text(text).find(wanted) if wanted else -1
    if at < 0:
        return None
    if text.isascii():
        return at, len(wanted)
    places = [i for i, letter in enumerate(text) for _ in _fold_letter(letter)]
    last = places[at + len(wanted) - 1] + 1
    end = next((i for i in range(last, len(text)) if _fold_letter(text[i])), len(text))
    return places[at], end - places[at]


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(StructType([StructField("start", LongType()), StructField("length", LongType())]))
def _find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, wanted in batches:
        found = [None if t is None or w is None else find_in_source(t, w) for t, w in zip(texts, wanted)]
        yield pd.DataFrame({"start": [f and f[0] + 1 for f in found], "length": [f and f[1] for f in found]}, dtype="Int64")


def fold_exact(x: Column | str) -> Column:
    """Lower case without combining marks, for any alphabet; null stays null."""
    return _fold(x)


def fold_state(x: Column | str) -> Column:
    """A state as it is compared: no-break spaces are blanks, marks and case don't count, blanks are squeezed; null is empty."""
    plain = F.replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(_fold(plain), r"(?U)\s+", " "))


def find_folded(text: Column | str, wanted: Column | str) -> Column:
    """start (from 1) and length in ``text`` itself of the first place that folds to what ``wanted`` folds to; nulls if none."""
    return _find(text, wanted)
