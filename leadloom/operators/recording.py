"""Events become claims: the newest document of each, a verbatim quote from it, one row a claim."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import folding
from leadloom.operators import dossier, identity
from leadloom.sources import versions

# The source of each kind of event, letters of a quote before and after its anchor, and how far a
# person's name may stand behind the date of the record.
SOURCES = {
    "director_joined": "ares", "director_departed": "ares", "owner_joined": "ares", "owner_departed": "ares",
    "management_vacancy": "mpsv", "subsidy_signed": "dotace_eu", "tender_open": "nen",
}
BACK, FORWARD, REACH = 320, 90, 1200
#: What stands before a date in the register's records, and how near.
FIELD, FIELD_REACH = '"datum', 40
SURNAME = '"prijmeni": "'

KEYS = ("ico", "kind", "value", "state", "quote")


def _literal(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))


def _last_name(name: Column) -> Column:
    return F.try_element_at(F.filter(F.split(F.coalesce(name, F.lit("")), r"(?U)\s+"), lambda w: w != ""), F.lit(-1))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def around(text: Column, anchor: Column) -> Column:
    """The first place of ``anchor`` in ``text`` with what stands around it; null if it isn't there or is empty."""

    def cut(at: Column) -> Column:
        start = F.greatest(at - BACK, F.lit(1))
        return F.when((anchor != "") & (at > 0), text.substr(start, at - start + F.length(anchor) + FORWARD))

    return _once(F.instr(text, anchor), cut)


def around_folded(text: Column, anchor: Column) -> Column:
    """:func:`around` for anchors that differ in case or marks from the text; the quote is the text's own."""
    found = folding.find_folded(text, anchor)
    at = found["start"].cast("int")
    start = F.greatest(at - BACK, F.lit(1))
    return F.when(at.isNotNull(), text.substr(start, at - start + found["length"].cast("int") + FORWARD))


def register_quote(text: Column, date: Column, name: Column) -> Column:
    """From a record's date through to the person's name; null if no such date has the name behind it.

    The date comes first, since a person may stand in the register more than once: the
    first place of the date that has the last name within REACH letters.  The quote begins
    at the date's field if that is near.
    """
    day = F.concat(F.lit('"'), date.cast("string"), F.lit('"'))
    last = _last_name(name)
    room = REACH - F.length(day) - F.length(last)
    pattern = F.concat(F.lit("(?s)"), _literal(day), F.lit(".{0,"), F.greatest(room, F.lit(0)).cast("string"), F.lit("}?"), _literal(last))

    def cut(found: Column) -> Column:
        def from_field(at: Column) -> Column:
            before = text.substr(F.greatest(at - FIELD_REACH, F.lit(1)), F.least(at - 1, F.lit(FIELD_REACH)))

            def whole(back: Column) -> Column:
                start = F.when(back > 0, at - back - len(FIELD) + 1).otherwise(at)
                return text.substr(start, at - start + F.length(found) + FORWARD)

            return _once(F.instr(F.reverse(before), F.lit(FIELD[::-1])), whole)

        return F.when(found.isNotNull(), _once(F.instr(text, found), from_field))

    return F.when(room >= 0, _once(F.regexp_substr(text, pattern), cut))


def evidence_quote(text: Column, folded: bool = False) -> Column:
    """A verbatim piece of ``text`` that backs an event; columns kind, date, name, subject, project, title, isco.

    People go by their record's date and name, else by the name alone; tenders by their
    subject, subsidies by their project, vacancies by title or occupation.  ``folded`` also
    takes anchors that differ from the text in case and marks, if none stands there verbatim.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    last = _last_name(F.col("name"))
    person = F.col("kind").rlike("^(director|owner)")
    named = [F.concat(F.lit(SURNAME), last, F.lit('"')), last]
    anchors = [
        (F.col("kind") == "tender_open", [F.substring(said("subject"), 1, 80)]), (F.col("kind") == "subsidy_signed", [F.substring(said("project"), 1, 80)]),
        (F.col("kind") == "management_vacancy", [said("title"), said("isco")]), (F.lit(True), named),
    ]
    chosen = None
    for which, words in anchors:
        tries = [around(text, w) for w in words] + [around_folded(text, w) for w in words if folded]
        chosen = F.when(which, F.coalesce(*tries)) if chosen is None else chosen.when(which, F.coalesce(*tries))
    return F.coalesce(F.when(person, register_quote(text, F.col("date"), F.col("name"))), chosen)


def claims_of(events: DataFrame, latest: DataFrame, run_id: int | Column | None = None, folded: bool = False) -> DataFrame:
    """ico, kind, value, quote, state, snapshot_id, run_id of each event; snapshot_id is null for orphans.

    ``events`` have ico, kind, url and what :func:`evidence_quote` and ``dossier.sentence``
    read; ``latest`` is the newest document of each company, source and url.  An event
    whose quote is found is a fact, others are inferences.
    """
    source = F.create_map(*[F.lit(x) for p in SOURCES.items() for x in p])[F.col("kind")]
    placed = identity.snapshot_for(events.withColumn("source", source), latest)
    texts = latest.select(F.col("id").alias("snapshot_id"), F.col("text").alias("__text"))
    read = placed.join(texts, "snapshot_id", "left").withColumn("quote", evidence_quote(F.col("__text"), folded)).withColumn("value", dossier.sentence())
    run = run_id if isinstance(run_id, Column) else F.lit(run_id).cast("long")
    state = F.when(F.col("quote").isNull(), "inference").when(F.contains("__text", "quote"), "fact").otherwise("discard")
    return read.select("ico", F.concat(F.lit("now:"), F.col("kind")).alias("kind"), "value", "quote", state.alias("state"), "snapshot_id", run.alias("run_id"))


def unknown(fresh: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows of ``fresh``, once each, whose company, kind, value, state and quote no claim has; nulls are equal."""
    once = fresh.groupBy(*KEYS).agg(F.min(F.struct("snapshot_id", "run_id")).alias("__first")).select(*KEYS, "__first.*")
    same = None
    for key in KEYS:
        one = once[key].eqNullSafe(claims[key])
        same = one if same is None else same & one
    return once.join(claims.select(*KEYS), same, "left_anti")


def record(events: DataFrame, latest: DataFrame, folder: str, run_id: int, folded: bool = False) -> dict[str, int]:
    """Record events in the versioned claims of ``folder``; tallies of what was seen, counted while it is written.

    written, orphaned, and how many of each state; ``added`` are the claims that were new.
    Events without a document are counted, not recorded.  A run that comes again adds nothing.
    """
    spark: SparkSession = events.sparkSession
    base = versions.latest(spark, folder)
    seen, added = Observation("seen"), Observation("added")
    orphan = F.col("snapshot_id").isNull()
    tally = [F.count_if(~orphan).alias("written"), F.count_if(orphan).alias("orphaned")]
    tally += [F.count_if(~orphan & (F.col("state") == s)).alias(s) for s in ("fact", "inference", "discard")]
    fresh = claims_of(events, latest, run_id, folded).observe(seen, *tally).where(~orphan)
    known = versions.read(spark, folder, base) if base else spark.createDataFrame([], fresh.schema)
    rows = unknown(fresh, known).select(*fresh.columns).observe(added, F.count(F.lit(1)).alias("added"))
    versions.commit(rows, folder, base, append=True)
    return {**seen.get, **added.get}
