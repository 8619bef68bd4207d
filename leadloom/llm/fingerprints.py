"""Bottom-k fingerprints of documents, by DataFrame functions alone.

A fingerprint holds the K smallest distinct hashes of a text's five-word shingles, in
ascending order.  Fingerprints of parts merge into that of the whole (the K smallest of
both), so parts of a corpus are sketched apart.  The K smallest of two fingerprints'
union are a sample of the union of both sets: the share of it that both hold estimates
resemblance; with the distinct counts, that gives containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes in a fingerprint, and words in a shingle.
K, WORDS = 128, 5


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles of a text in lower case; null and blank texts have none.

    A text of fewer words has its whole word sequence as one shingle.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - words, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))

    # One variable for the word hashes: an expression named in a lambda is computed once.
    return F.flatten(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, shingles(h)).otherwise(F.array().cast("array<bigint>"))))


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom_k(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both parts together."""
    return bottom_k(F.array_union(a, b), k)


def distinct_shingles(f: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.get(f, k - 1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(f) < k, F.size(f).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sets are alike."""
    both = F.array_intersect(a, b)
    # The smallest of the union: those of either side up to the last place that counts.
    union = bottom_k(F.array_union(a, b), k)
    alike = F.size(F.array_intersect(union, both)).cast("double") / F.size(union)
    return F.when(F.size(union) == 0, 1.0).otherwise(alike)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty set is contained."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(f: Column) -> Column:
    """A fingerprint as a string: 16 lower-case hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(f, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def range_bounds(ids: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ids that cut all ids into ranges of about as many rows each."""
    shares = [i / parts for i in range(1, parts)]
    return sorted({int(x) for x in ids.where(F.col(id_col).isNotNull()).approxQuantile(id_col, shares, 0.2 / parts)}) if shares else []


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` a value reaches: a search in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    reached = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    chunk = reached(F.array(*[F.lit(c[0]) for c in chunks])) - 1
    inside = reached(F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), F.greatest(chunk, F.lit(0))))
    return F.greatest(chunk, F.lit(0)) * width + F.when(chunk >= 0, inside).otherwise(0)


def with_next(rows: DataFrame, id_col: str, value: str, made: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``next``: ``value`` and ``made`` of the next larger id, of the first after the last.

    Rows are dealt once, by ranges of the id; each range also gets the first row of the
    range after it.  ``made`` are columns that are computed from a row where it was dealt
    to, once for the row and the one before it.  Where an id repeats, its least value
    stands for it.  Rows without an id have a null ``next`` and are dealt by their values.
    """
    spark, made = rows.sparkSession, made or {}
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = range_bounds(rows, id_col, 3 * parts)  # more ranges than partitions: hashing spreads them evenly
    place = range_of(F.col(id_col), bounds)
    firsts = rows.where(F.col(id_col).isNotNull()).groupBy(place.alias("range")).agg(F.min(id_col).alias("first")).orderBy("range").collect()
    before = {r["first"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    spread = -1 - F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")
    home = F.struct(F.when(F.col(id_col).isNull(), spread).otherwise(place).cast("int").alias("range"), F.lit(False).alias("guest"))
    if before:
        table = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        guest = F.when(F.col(id_col).isin(*before), F.struct(table[F.col(id_col)].cast("int").alias("range"), F.lit(True).alias("guest")))
        homes = F.filter(F.array(home, guest), lambda h: h.isNotNull())
    else:
        homes = F.array(home)
    dealt = rows.withColumn("__home", F.explode(homes)).select("*", "__home.range", "__home.guest").drop("__home").repartition(parts, "range").select("*", *[c.alias(n) for n, c in made.items()])
    order = f"(PARTITION BY range ORDER BY guest, {id_col}, {value})"
    marked = dealt.withColumn("__lead", F.expr(f"CASE WHEN {id_col} <=> lag({id_col}) OVER {order} AND guest = lag(guest) OVER {order} THEN NULL ELSE struct({', '.join([value, *made])}) END"))
    found = marked.withColumn("next", F.expr(f"lead(__lead) IGNORE NULLS OVER {order}")).where("not guest")
    return found.withColumn("next", F.when(F.col(id_col).isNotNull(), F.col("next"))).drop("range", "guest", "__lead")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Each text's fingerprint and that of its edited text.

    The edited text has its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document's text, by ascending id; the first follows the last.
    A null text is an empty one.  Of rows that repeat an id, the least text stands for
    that id as a neighbour; each row keeps its own fingerprint.  A row with a null id has
    no next document: its edited text ends where the replaced part began, near_next is
    null.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    followed = with_next(rows, "doc_id", "text", {"f": fingerprint(F.col("text"), k, words), "n_chars": F.length("text").cast("long")})
    start = F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))")
    end = F.expr("substring(coalesce(next.text, ''), 1, cast(n_chars div 2 as int))")
    made = followed.select("doc_id", "n_chars", "f", F.concat(start, end).alias("edited"), F.col("next.f").alias("next_f"))
    made = made.select("*", fingerprint(F.col("edited"), k, words).alias("edited_f"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("edited_f")).alias("edited_fingerprint"),
        resemblance(F.col("f"), F.col("edited_f"), k).alias("near_edited"),
        F.when(F.col("next_f").isNotNull(), resemblance(F.col("f"), F.col("next_f"), k)).alias("near_next"),
        distinct_shingles(F.col("f"), k).alias("shingles"),
        containment(F.col("f"), F.col("edited_f"), k).alias("contained_in_edited"),
    )
