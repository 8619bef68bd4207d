"""Evidence: latest documents, quote verification, and claims that may be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text as X

# Patterns of statements that evidence is missing, and of quotes that
# argue against the sign they were filed under.
NEGATION = r"(?:není|nejsou|nebyl\w*|chybí|nelze|nemá|nemáme|nenalez\w*|neuvád\w*|nezmiňuj\w*|neobsahuj\w*)"
OBJECT = (
    r"(?:uveden\w*|zmín\w*|zmiňuj\w*|explicit\w*|doložen\w*|doklad\w*|informac\w*|údaj\w*|patrn\w*|dostupn\w*|nalezen\w*|k dispozici)"
)
ABSENCE = rf"(?iU)\b{NEGATION}\b(?:\W+\w+){{0,4}}?\W+{OBJECT}"
ABSENCE_VERB = r"(?iU)\b(?:nezmiňuj\w*|neuvád\w*|neobsahuj\w*|nenalez\w*)\b"
SINGLE_SHIFT = r"(?iU)(jednosměnn\w*|jedn[uú]\s*směn\w*|jedna\s*směn\w*)"
TRAINING = r"(?iU)(zauč|zaškol|zaprac|zácvik|proškol)"
TRAINING_SPECIFIC = r"(?iU)(\d|měsíc\w*|rok\w*|týdn\w*|ústně|ústní|předáván\w*|zástupc\w*|nástupc\w*|jedin\w*|odchod\w*)"


def latest_documents(index: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """The newest snapshot of each company and url; null urls are one group."""
    rows = index.where(F.col("source").isin(*sources)) if sources else index
    rest = [x for x in rows.columns if x not in ("ico", "url", "fetched_at", "id")]
    best = rows.groupBy("ico", "url").agg(F.max(F.struct("fetched_at", "id", *rest)).alias("b"))
    return best.select("ico", "url", "b.fetched_at", "b.id", *[F.col(f"b.{x}").alias(x) for x in rest])


def states_absence(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    return text.rlike(ABSENCE) | text.rlike(ABSENCE_VERB)


def argues_against(kind: Column, quote: Column) -> Column:
    q = F.coalesce(quote, F.lit(""))
    return F.when(kind == "pain:scale", q.rlike(SINGLE_SHIFT)).when(kind == "pain:tacit_knowledge", q.rlike(TRAINING) & ~q.rlike(TRAINING_SPECIFIC)).otherwise(False)


def counts() -> Column:
    """Whether a claim may be shown and scored; a claim nobody judged still counts."""
    quote = F.coalesce("quote", F.lit(""))
    absent = (quote == "") & states_absence(F.col("value"))
    return ~(F.col("relevance").eqNullSafe(F.lit("unrelated")) | absent | argues_against(F.col("kind"), quote))


def _longest(words: Column) -> Column:
    return F.get(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 0)["w"]


def _candidates(quoted: DataFrame, split: DataFrame) -> DataFrame:
    """finding_id, snapshot_id of all documents that may contain a form of a quote.

    ``split`` has snapshot_id and __word, the words of each document in small letters.
    Only inner words of a form are whole words of a text that contains it; a form of one
    or two words has none, so its longest word is looked for inside the texts' words.
    """
    forms = F.array_distinct(F.transform(X.quote_forms(F.col("quote")), lambda f: F.split(F.lower(X.normalise(f)), " ")))
    long = F.transform(F.filter(forms, lambda w: F.size(w) > 2), lambda w: _longest(F.slice(w, 2, F.size(w) - 2)))
    short = F.filter(F.transform(F.filter(forms, lambda w: F.size(w) < 3), _longest), lambda w: w != "")
    found = quoted.select("finding_id", F.explode(F.array_distinct(long)).alias("__word")).join(split, "__word")
    parts = quoted.select("finding_id", F.explode(F.array_distinct(short)).alias("__part"))
    if not parts.isEmpty():
        gram = F.substring("__part", 1, 3)
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__word") - n + 1)), lambda i: F.col("__word").substr(i, F.lit(n)))
        words = split.select("__word").distinct().select("__word", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("__gram"))
        asked = parts.select("__part").distinct().withColumn("__gram", gram)
        holding = asked.join(words, "__gram").where(F.contains("__word", "__part")).select("__part", "__word")
        found = found.unionByName(parts.join(holding, "__part").select("finding_id", "__word").distinct().join(split, "__word"))
    return found.select("finding_id", "snapshot_id").distinct()


def verify_quotes(findings: DataFrame, documents: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Findings with state, matched form and snapshot_id.

    A finding without a quote is an inference; a quote that a candidate document contains
    is a fact, of the first such document; any other is a discard, under the first
    document.  ``on`` names the columns that findings and documents share (as a rule the
    company).  Without it every document is a candidate; then the longest inner word of
    each form of the quote is the join key, and forms of one or two words go by the words
    that contain their longest one, so texts and quotes never meet as a cross product.
    """
    quoted = findings.where("quote is not null and quote <> ''")
    if on:
        pairs = quoted.join(documents.select(*on, F.col("id").alias("snapshot_id"), "text"), on)
    else:
        split = documents.select(F.col("id").alias("snapshot_id"), F.explode(F.array_distinct(F.split(F.lower(X.normalise("text")), " "))).alias("__word"))
        near = quoted.join(_candidates(quoted, split), "finding_id")
        pairs = near.join(documents.select(F.col("id").alias("snapshot_id"), "text"), "snapshot_id")
    found = pairs.withColumn("matched", X.find_quote(F.col("quote"), F.col("text"))).groupBy("finding_id").agg(
        F.min(F.when(F.col("matched").isNotNull(), F.struct("snapshot_id", "matched"))).alias("hit"), F.min("snapshot_id").alias("first_id")
    )
    judged = findings.join(found, "finding_id", "left")
    empty = F.coalesce("quote", F.lit("")) == ""
    state = F.when(empty, "inference").when(F.col("hit").isNotNull(), "fact").otherwise("discard")
    return judged.select(*findings.columns, state.alias("state"), F.col("hit.matched").alias("matched"), F.coalesce("hit.snapshot_id", "first_id").alias("snapshot_id"))


def merge_claims(claims: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per (ico, kind, value, state, quote), with the newest snapshot; nulls are equal."""
    keys = ["ico", "kind", "value", "state", "quote"]
    return claims.select(*keys, "snapshot_id").unionByName(fresh.select(*keys, "snapshot_id")).groupBy(*keys).agg(F.max("snapshot_id").alias("snapshot_id"))


def apply_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with the judge's words; others than the two known are not taken."""
    known = verdicts.where(F.col("verdict").isin("supports", "unrelated")).select("claim_id", "verdict")
    return claims.join(known, "claim_id", "left").withColumn("relevance", F.coalesce("verdict", "relevance")).drop("verdict")


def newest_pass(claims: DataFrame) -> DataFrame:
    """Per company and family of kinds, the rows of the newest run; rows without a run stay."""
    of = [F.col("ico"), X.family("kind")]
    top = F.max("run_id").over(Window.partitionBy(*of))
    return claims.withColumn("__top", top).where("run_id is null or run_id = __top").drop("__top")


def usable(claims: DataFrame) -> DataFrame:
    """Claims that may be shown: of the newest pass, admissible, one per quote.

    Of several claims on one quote the judged one wins, then the specific kind, then the
    newest.  Claims without a quote are one per family and statement.  Quotes may be whole
    documents, so claims are grouped and sorted by digests.
    """
    rows = newest_pass(claims).where(counts())
    has = F.coalesce("quote", F.lit("")) != ""
    said = F.when(has, X.squeeze_stop(F.col("quote"))).otherwise(F.lower(X.normalise("value")))
    key = F.struct(has.alias("q"), F.when(has, "").otherwise(X.family("kind")).alias("f"), F.sha2(said.cast("binary"), 256).alias("k"))
    order = Window.partitionBy("ico", "__key").orderBy(F.col("relevance").eqNullSafe(F.lit("supports")).desc(), F.contains("kind", F.lit(":")).desc(), F.col("claim_id").desc())
    return rows.withColumn("__key", key).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__key", "__n")


def richness(claims: DataFrame) -> DataFrame:
    """Per company: facts, inferences, facts that aren't about the mode, and what doesn't count."""
    rows = claims.where(~F.startswith("kind", F.lit("now:")))
    kept = usable(rows).groupBy("ico").agg(
        F.count_if(F.col("state") == "fact").alias("facts"), F.count_if(F.col("state") == "inference").alias("inferences"),
        F.count_if((F.col("state") == "fact") & (X.family("kind") != "production_mode")).alias("signal_facts"), F.count("*").alias("kept"),
    )
    every = rows.groupBy("ico").agg(F.count("*").alias("total"), F.count_if(~counts()).alias("inadmissible"))
    joined = every.join(kept, "ico", "left").na.fill(0)
    return joined.select("ico", "facts", "inferences", "signal_facts", (F.col("total") - F.col("kept")).alias("not_kept"), "inadmissible")


def mode_verdict(findings: DataFrame, companies: DataFrame | None = None, allow_mixed: bool = True, source_rank: dict[str, int] | None = None) -> DataFrame:
    """ico, mode, basis: how a company says it produces, or what its texts only suggest.

    ``findings``: ico, side, kind (direct or structural), hits, and source where sides of
    unequal sources are weighed.  One directly named side is the mode; two, or one that
    is itself "mixed", are mixed (or, without ``allow_mixed``, the side of the best ranked
    source, small batches last).  Without a direct statement the side of more hits is
    only leaned to, a tie tells nothing.  ``companies`` adds those without findings.
    """
    direct, structural = F.col("kind") == "direct", F.col("kind") == "structural"
    hits = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("hits"))), F.lit(0))
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in (source_rank or {"": 0}).items() for x in p])[F.col("source")], F.lit(0)) if "source" in findings.columns else F.lit(0)
    view = findings.groupBy("ico").agg(
        F.collect_set(F.when(direct & F.col("side").isin("made_to_order", "serial", "small_batch"), F.col("side"))).alias("stated"), F.coalesce(F.bool_or(direct & (F.col("side") == "mixed")), F.lit(False)).alias("said_mixed"),
        F.max(F.when(direct, F.struct(rank.alias("rank"), (F.col("side") != "small_batch").alias("whole"), "side")))["side"].alias("best"), hits("made_to_order").alias("order"), hits("serial").alias("serial"),
    )
    many = F.size("stated") > 1
    mixed = (F.col("said_mixed") | many) if allow_mixed else F.lit(False)
    leaning = F.when(F.col("order") == F.col("serial"), "unknown").when(F.col("order") > F.col("serial"), "leaning_made_to_order").otherwise("leaning_serial")
    mode = F.when(mixed, "mixed").when(many, F.col("best")).when(F.size("stated") == 1, F.get("stated", 0)).otherwise(leaning)
    basis = F.when(mixed | (F.size("stated") > 0), "direct").when(F.col("order") == F.col("serial"), "structural_tie").otherwise("structural")
    told = view.select("ico", mode.alias("mode"), basis.alias("basis"))
    if companies is None:
        return told
    return companies.select("ico").join(told, "ico", "left").withColumn("mode", F.coalesce("mode", F.lit("unknown")))


def document_budget(documents: DataFrame, priority: dict[str, int], per_kind: int = 3, total: int = 12, reserved: str = "vacancy", chars: int = 16_000) -> DataFrame:
    """The documents a reader gets: few per kind, by kind's priority, one slot kept for ``reserved``."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in priority.items() for x in p])[F.col("kind")], F.lit(len(priority)))
    per = Window.partitionBy("ico", "kind").orderBy(F.col("id").desc())
    rows = documents.withColumn("rank", rank).withColumn("__k", F.row_number().over(per)).where(F.col("__k") <= per_kind)
    company = Window.partitionBy("ico")
    rows = rows.withColumn("__has", F.max(F.col("kind") == reserved).over(company))
    order = company.orderBy("rank", F.col("id").desc())
    plain = rows.where(F.col("kind") != reserved).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= F.when(F.col("__has"), total - 1).otherwise(total))
    special = rows.where(F.col("kind") == reserved).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return plain.unionByName(special).select(*documents.columns, "rank").withColumn("text", F.substring("text", 1, chars))


def unjudged(claims: DataFrame, family: str = "pain") -> DataFrame:
    """Facts of a family with a quote that no judge has seen."""
    return claims.where((X.family("kind") == family) & (F.col("state") == "fact") & (F.coalesce("quote", F.lit("")) != "") & F.col("relevance").isNull())


def judge_report(claims: DataFrame, family: str = "pain") -> DataFrame:
    """ico, supports, unrelated, unjudged: what the judge said of a family's facts."""
    rows = claims.where((X.family("kind") == family) & (F.col("state") == "fact"))
    return rows.groupBy("ico").agg(F.count_if(F.col("relevance") == "supports").alias("supports"), F.count_if(F.col("relevance") == "unrelated").alias("unrelated"), F.count_if(F.col("relevance").isNull()).alias("unjudged"))


def store_statistics(index: DataFrame) -> DataFrame:
    """One row: snapshots, distinct texts, companies with any."""
    return index.agg(F.count("*").alias("snapshots"), F.count_distinct("sha256").alias("texts"), F.count_distinct("ico").alias("companies"))


def kind_spread(claims: DataFrame) -> DataFrame:
    """kind, companies, n: over how many companies each kind of claim is spread."""
    return claims.groupBy("kind").agg(F.count_distinct("ico").alias("companies"), F.count("*").alias("n"))


def contradicted(claims: DataFrame, current: DataFrame) -> DataFrame:
    """Claims without departures that the register contradicts: somebody still listed in that role is named in the sentence.

    ``current``: ico, role, name.  Names are compared in small letters, as parts of the value.
    """
    departed = F.regexp_extract("kind", r"^now:(director|owner)_departed$", 1)
    names = current.where("name <> ''").groupBy("ico", "role").agg(F.collect_set(F.lower("name")).alias("__names"))
    joined = claims.withColumn("__role", departed).join(names.select("ico", F.col("role").alias("__role"), "__names"), ["ico", "__role"], "left")
    said = F.lower(F.coalesce("value", F.lit("")))
    return joined.where(~F.coalesce(F.exists("__names", lambda n: F.contains(said, n)), F.lit(False))).select(*claims.columns)


#: Fixed value: a turnover word, and an amount with its unit in the same sentence.
TURNOVER = r"(?i)(?:obrat|tr[žz]by|v[ýy]nosy|turnover|revenue)[^.]{0,60}?\d[\d\s.,]{0,12}\s*(?:mil|mld|tis|milion|miliard|m\.?\s*K[čc]|K[čc]|EUR|USD)"


def turnover_pages(documents: DataFrame, context: int = 400) -> DataFrame:
    """id, ico, excerpt: documents that name a turnover, with the text around the first place."""
    at = F.instr(F.col("text"), F.regexp_substr("text", F.lit(TURNOVER)))
    rows = documents.where(F.col("text").rlike(TURNOVER)).withColumn("__at", at)
    return rows.select("id", "ico", F.substring("text", F.greatest(F.lit(1), F.col("__at") - context), F.lit(2 * context)).alias("excerpt"))


BETWEEN = "\n\n---\n\n"


def vacancy_documents(vacancies: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ico, text, sha256, snapshot_id of each company's vacancies as prose, and those of them to be stored.

    ``vacancies``: ico, pos, title, text; ``stored``: ico, source, id, fetched_at, sha256.
    Where a company's newest stored document of that source has the same digest, its id is
    used again and nothing is stored; else snapshot_id is null, and the document is among
    those to be stored.  Companies with nothing but blanks to say have no document.
    """
    told = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    listed = vacancies.groupBy("ico").agg(F.array_sort(F.collect_list(F.struct("pos", told.alias("told")))).alias("rows"))
    made = listed.select("ico", F.array_join(F.transform("rows", lambda r: r["told"]), BETWEEN).alias("text")).where(X.normalise("text") != "").withColumn("sha256", X.digest("text"))
    newest = stored.where("source = 'mpsv_text'").groupBy("ico").agg(F.max(F.struct("fetched_at", "id", "sha256")).alias("n"))
    found = made.join(newest, "ico", "left").select("ico", "text", "sha256", F.when(F.col("n.sha256") == F.col("sha256"), F.col("n.id")).alias("snapshot_id"))
    return found, found.where("snapshot_id is null").drop("snapshot_id")
