"""Text, key and date expressions; all are Column -> Column and stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, position by position (fixed values).
MARKED = "áäąâãåčćçďéěëęèêíîïľĺłňńñóôöőòõŕřšśťúůüűùûýžźżß"
PLAIN = "aaaaaacccdeeeeeeiiilllnnnoooooorrsstuuuuuuyzzzs"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(x: Column | str) -> Column:
    """White space of any kind to single blanks, trimmed; null to the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c(x), F.lit("")), r"(?U)\s+", " "))


def fold(x: Column | str) -> Column:
    """Lower case without the marks of known alphabets; one character stays one."""
    return F.translate(F.lower(c(x)), MARKED, PLAIN)


def fold_marks(x: Column | str) -> Column:
    """:func:`fold` that also drops marks which stand as characters of their own, so lengths may change."""
    return F.regexp_replace(fold(x), r"\p{M}+", "")


def company_key(x: Column | str) -> Column:
    """Eight digits, padded with zeros; longer keys stay, all zeros and blanks are null."""
    text = F.trim(c(x).cast("string"))
    padded = F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text)
    return F.when((text == "") | text.rlike("^0*$"), None).otherwise(padded)


def digest(x: Column | str) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalise(x).cast("binary"), 256)


def request_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *map(c, parts)).cast("binary"), 256)


def occupation_group(x: Column | str) -> Column:
    """First four characters after the last slash."""
    return F.substring(F.element_at(F.split(c(x), "/"), -1), 1, 4)


def family(kind: Column | str) -> Column:
    return F.split(c(kind), ":")[0]


def parse_day(x: Column | str) -> Column:
    """The first ``d. m. yyyy`` in a text as a date, or null."""
    pattern = r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})"
    parts = [F.regexp_extract(c(x), pattern, i) for i in (3, 2, 1)]
    return F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-M-d")).cast("date")


def iso_day(x: Column | str, floor: str | None = None, as_of: str | None = None) -> Column:
    """The date at a text's start; null if unreadable, before ``floor`` or after ``as_of``."""
    day = F.substring(c(x), 1, 10).try_cast("date")
    for limit, bad in ((floor, lambda d, v: d < v), (as_of, lambda d, v: d > v)):
        if limit:
            day = F.when(~bad(day, F.lit(limit).cast("date")), day)
    return day


def serial_day(x: Column | str) -> Column:
    """A spreadsheet's day number as a date; null below 1."""
    n = F.floor(c(x).try_cast("double")).cast("int")
    return F.when(n >= 1, F.date_add(F.lit("1899-12-30").cast("date"), n))


def prefix_match(code: Column | str, prefixes: Sequence[str], on_missing: str = "pass") -> Column:
    """Whether a code and a prefix agree as far as both go, in either direction.

    An empty code passes, fails or is unknown (null), as ``on_missing`` says.
    """
    missing = {"pass": F.lit(True), "fail": F.lit(False), "unknown": F.lit(None).cast("boolean")}[on_missing]
    code = F.coalesce(c(code), F.lit(""))
    either = reduce(lambda a, b: a | b, [F.startswith(code, F.lit(p)) | F.startswith(F.lit(p), code) for p in prefixes], F.lit(False))
    return F.when(code == "", missing).otherwise(either)


def first_reason(*steps: tuple[Column, Column | str]) -> Column:
    """The reason of the first condition that holds, or null."""
    return F.coalesce(*[F.when(cond, F.lit(r) if isinstance(r, str) else r) for cond, r in steps])


def one_of(value: Column | str, allowed: Sequence[str], name: str) -> Column:
    """Null if the value is allowed or nothing is asked; else ``name`` or ``name_unknown``."""
    v = F.coalesce(c(value), F.lit(""))
    if not allowed:
        return F.lit(None).cast("string")
    return F.when(v == "", f"{name}_unknown").when(~v.isin(*allowed), name)


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, one decimal; null if any coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.floor(2 * 6371 * F.asin(F.sqrt(h)) * 10 + 0.5) / 10


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first rule (label, pattern) that a text matches."""
    return F.coalesce(*[F.when(text.rlike(p), label) for label, p in rules], F.lit(default))


def quote_forms(quote: Column) -> Column:
    """A quote as given, unwrapped, without a closing ellipsis, without one closing stop."""
    marks = "[\"„“”‘’']"
    unwrapped = F.when(quote.rlike(f"(?s)^{marks}.*{marks}$") & (F.length(quote) >= 2), F.substring(quote, F.lit(2), F.length(quote) - 2))
    base = F.filter(F.array(quote, unwrapped), lambda x: x.isNotNull())
    trimmed = F.transform(base, lambda x: F.rtrim(F.regexp_replace(x, r"(?:\.{2,}|…)\s*$", "")))
    cut = F.filter(trimmed, lambda x: ~x.rlike(r"\.{2,}|…"))
    both = F.array_distinct(F.concat(base, cut))
    stopped = F.transform(both, lambda x: F.rtrim(F.regexp_replace(x, r"(?<!\.)\.\s*$", "")))
    return F.filter(F.array_distinct(F.concat(both, stopped)), lambda x: x != "")


def find_quote(quote: Column, text: Column) -> Column:
    """The form of a quote that a text contains, or null; case is tried last.

    Both sides are compared with white space normalised.  Where only the case differs,
    the text's own spelling is returned.
    """
    body = normalise(text)
    forms = F.transform(quote_forms(quote), normalise)
    exact = F.get(F.filter(forms, lambda x: F.contains(body, x)), 0)
    near = F.get(F.filter(forms, lambda x: F.contains(F.lower(body), F.lower(x))), 0)
    own = F.substring(body, F.position(F.lower(near), F.lower(body)), F.length(near))
    return F.when((quote == "") | quote.isNull(), None).otherwise(F.coalesce(exact, own))


def squeeze_stop(quote: Column) -> Column:
    """The form in which two quotes are the same sentence."""
    return F.lower(F.rtrim(F.regexp_replace(normalise(quote), r"(?<!\.)\.\s*$", "")))
