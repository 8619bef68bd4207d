"""Certificates: standards that texts name, who issued them, their numbers, and one list a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators.evidence import counts

# How standards are written, bodies that issue certificates, the label before a number, what a number looks
# like, and dates that look like one.
STANDARDS = (
    ("IATF 16949", r"(?iU)\bIATF\s*[-: ]?\s*16949"),
    ("EN 1090", r"(?iU)\b(?:[ČC]SN\s+)?EN\s*[-: ]?\s*1090(?:-\d)?"),
    ("ISO 9001", r"(?iU)\b(?:[ČC]SN\s+)?(?:EN\s+)?ISO\s*[-: ]?\s*9001"),
    ("ISO 14001", r"(?iU)\b(?:[ČC]SN\s+)?(?:EN\s+)?ISO\s*[-: ]?\s*14001"),
    ("ISO 45001", r"(?iU)\b(?:[ČC]SN\s+)?(?:EN\s+)?ISO\s*[-: ]?\s*45001"),
    ("ISO 50001", r"(?iU)\b(?:[ČC]SN\s+)?(?:EN\s+)?ISO\s*[-: ]?\s*50001"),
    ("ISO 3834", r"(?iU)\b(?:[ČC]SN\s+)?(?:EN\s+)?ISO\s*[-: ]?\s*3834(?:-\d)?"),
    ("ISO 27001", r"(?iU)\bISO(?:/IEC)?\s*[-: ]?\s*27001"),
    ("ISO 13485", r"(?iU)\b(?:[ČC]SN\s+)?(?:EN\s+)?ISO\s*[-: ]?\s*13485"),
)
ISSUERS = (
    r"(?iU)\b(Bureau\s+Veritas|T[UÜ]V\s*(?:S[UÜ]D|NORD|Rheinland|SUD)?|DNV(?:\s*GL)?|LRQA|Lloyd'?s\s+Register|SGS|DEKRA|DQS|CQS|"
    r"ITC\s+Zl[ií]n|EZ[UÚ]|Certline|QUALIFORM|Strojírenský\s+zku[sš]ebn[ií]\s+[uú]stav|TZ[UÚ])\b"
)
NUMBER_LABEL = (
    r"(?iU)\b(?:registra[cč]n[ií]\s+[cč][ií]sl[oa]|[cč][ií]slo\s+certifik[aá]tu|registra[cč]n[ií]\s+[cč]\.|"
    r"certificate\s+(?:registration\s+)?(?:no|number)|reg\.?\s*no|zertifikat-?registrier)"
)
NUMBER_SHAPE = r"(?U)\b(\d[\d\s/\-]{4,}\d(?:\s+[A-Z][A-Z0-9]{1,7})?|[A-Z]{1,4}[-/ ]?\d{4,}[-/A-Z0-9]*)\b"
DATE_SHAPE = r"^(?:(?:19|20)\d{2}(?:[-./]\d{1,2}){0,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})$"
BEFORE_NUMBER = " (č. "
#: Letters around a standard that are its quote, letters after a label in which its number stands, the least digits of a
#: number, and the least letters of a document that isn't only a picture (fixed values).
AROUND, NUMBER_WITHIN, LEAST_DIGITS, LEAST_TEXT = 80, 220, 5, 200
COLUMNS = ("ico", "standard", "number", "issuer", "tier", "quote", "snapshot_id")


def issuer(text: Column) -> Column:
    """The first body that a text names as one that issues certificates, or null."""
    return F.nullif(X.normalise(F.regexp_substr(text, F.lit(ISSUERS))), F.lit(""))


def registration_number(text: Column) -> Column:
    """The first thing shaped like a number, and not like a date, soon after the first label of one; or null."""
    label = F.regexp_substr(text, F.lit(NUMBER_LABEL))
    window = F.substring(text, F.regexp_instr(text, F.lit(NUMBER_LABEL)) + F.length(label), F.lit(NUMBER_WITHIN))
    tokens = F.transform(F.regexp_extract_all(window, F.lit(NUMBER_SHAPE), F.lit(1)), lambda t: F.regexp_replace(X.normalise(t), r"^[ .\-/]+|[ .\-/]+$", ""))
    head = lambda t: F.trim(F.regexp_extract(t, r"^[\d\s/\-.]+", 0))
    fits = lambda t: ~head(t).rlike(DATE_SHAPE) & ~t.rlike(DATE_SHAPE) & (F.length(F.regexp_replace(t, r"\D", "")) >= LEAST_DIGITS)
    return F.when(label.isNotNull(), F.get(F.filter(tokens, fits), 0))


def _named(documents: DataFrame) -> DataFrame:
    """A row for each standard that a document names: the columns of ``documents`` but text, standard, quote and issuer."""
    said = [F.struct(F.lit(name).alias("standard"), F.regexp_instr("text", F.lit(p)).alias("at"), F.length(F.regexp_substr("text", F.lit(p))).alias("size")) for name, p in STANDARDS]
    rows = documents.where(F.col("text").rlike("(?i)ISO|IATF|EN")).select("*", F.inline(F.filter(F.array(*said), lambda s: s["at"] > 0)))
    start = F.greatest(F.lit(1), F.col("at") - AROUND)
    quote = F.regexp_replace(F.substring("text", start, F.col("at") + F.col("size") + AROUND - start), r"(?U)^\s+|\s+$", "")
    return rows.select(*[c for c in documents.columns if c != "text"], "text", "standard", quote.alias("quote"), issuer(F.col("text")).alias("issuer"))


def certificates(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """ico, standard, number, issuer, tier, quote, snapshot_id of all that a company's pages and stored certificates say.

    ``pages`` and ``documents``: ico, id, text.  Of a company's pages the first (by id) that names
    a standard is taken, with the issuer of that page (``page``); a stored certificate gives all its
    standards with its number and issuer (``pdf``), or one row without a standard where its text is
    too short to be more than a picture's (``scanned``).  Null texts are empty.  Texts aren't shuffled.
    """
    prepared = lambda rows: rows.select("ico", "id", F.coalesce("text", F.lit("")).alias("text"))
    null = F.lit(None).cast("string")
    first = _named(prepared(pages)).groupBy("ico", "standard").agg(F.min_by(F.struct("issuer", "quote", "id"), "id").alias("b"))
    stated = first.select("ico", "standard", null.alias("number"), "b.issuer", F.lit("page").alias("tier"), "b.quote", F.col("b.id").alias("snapshot_id"))
    stored = prepared(documents)
    long = F.length("text") >= LEAST_TEXT
    read = _named(stored.where(long)).select("ico", "standard", registration_number(F.col("text")).alias("number"), "issuer", F.lit("pdf").alias("tier"), "quote", F.col("id").alias("snapshot_id"))
    scanned = stored.where(~long).select("ico", null.alias("standard"), null.alias("number"), null.alias("issuer"), F.lit("scanned").alias("tier"), null.alias("quote"), F.col("id").alias("snapshot_id"))
    return stated.unionByName(read).unionByName(scanned).select(*COLUMNS)


def certificate_claims(found: DataFrame, documents: DataFrame) -> DataFrame:
    """ico, kind, value, quote, state, snapshot_id: certificates as claims, each quote sought in the document it is from.

    ``documents``: id, text.  Rows without a standard make no claim; a document that is gone discards the claim.
    """
    texts = documents.select(F.col("id").alias("snapshot_id"), F.col("text").alias("__text"))
    rows = found.where("standard is not null and snapshot_id is not null").join(texts, "snapshot_id", "left")
    value = F.concat("standard", F.when(F.col("number").isNotNull(), F.concat(F.lit(BEFORE_NUMBER), "number", F.lit(")"))).otherwise(""))
    state = F.when(F.coalesce("quote", F.lit("")) == "", "inference").when(X.find_quote(F.col("quote"), F.col("__text")).isNotNull(), "fact").otherwise("discard")
    return rows.select("ico", F.concat(F.lit("certificate:"), "tier").alias("kind"), value.alias("value"), "quote", state.alias("state"), "snapshot_id")


def company_certificates(claims: DataFrame, kept: DataFrame) -> DataFrame:
    """ico, standard, number, tier, quote: one row for each standard of a company.

    Proven claims (``claims`` with claim_id and relevance) go first, of each standard the one of the
    smallest claim_id; only a company without any has the rows of ``kept``, an older file.
    """
    proven = claims.where(F.startswith("kind", F.lit("certificate:")) & (F.col("state") == "fact") & counts())
    value = F.coalesce("value", F.lit(""))
    number = F.trim(F.rtrim(F.get(F.split(value, r" \(č\. ", 2), 1), F.lit(")")))
    rows = proven.select("ico", "claim_id", F.trim(F.substring_index(value, BEFORE_NUMBER, 1)).alias("standard"), F.nullif(number, F.lit("")).alias("number"), F.get(F.split("kind", ":", 2), 1).alias("tier"), "quote")
    one = rows.groupBy("ico", "standard").agg(F.min_by(F.struct("number", "tier", "quote"), "claim_id").alias("c")).select("ico", "standard", "c.*")
    rest = kept.join(rows.select("ico").distinct(), "ico", "left_anti")
    return one.unionByName(rest.select("ico", "standard", "number", "tier", "quote"))
