"""Change batches as a stream: idempotent, with late batches flagged instead of lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_batches(spark: SparkSession, folder: str, schema: StructType | str, per_trigger: int = 10) -> DataFrame:
    """Landed batch files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_each(changes: DataFrame, keys: list[str], time_col: str = "ts", delay: str = "7 days") -> DataFrame:
    """Each repeated record once, as long as its copies come within ``delay``."""
    timed = changes.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def flag_uncovered(changes: DataFrame, retained_from: str, time_col: str = "ts") -> DataFrame:
    """``uncovered`` marks records from before the retained history: the answer is "cannot tell"."""
    return changes.withColumn("uncovered", F.col(time_col) < F.lit(retained_from).cast("timestamp"))


def weekly_counts(changes: DataFrame, time_col: str = "ts", delay: str = "7 days") -> DataFrame:
    timed = changes.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).groupBy(F.window(time_col, "7 days").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "kind", "n")


def last_in_batch(batch: DataFrame) -> DataFrame:
    """The last change of each company in a micro-batch, by batch number and position."""
    return batch.groupBy("ico").agg(F.max(F.struct("batch", "pos", "kind")).alias("b")).select("ico", "b.batch", "b.pos", "b.kind")


def merge_into(stream: DataFrame, read_base: Callable[[], DataFrame | None], write_base: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that keeps a table of each company's last change.

    A micro-batch that comes again changes nothing: a change replaces what the base has
    only if its (batch, pos) is larger.
    """

    def apply(batch: DataFrame, number: int) -> None:
        base = read_base()
        rows = last_in_batch(batch)
        write_base(last_in_batch(rows if base is None else base.unionByName(rows)), number)

    return stream.writeStream.foreachBatch(apply).outputMode("append")


#: The setting that state with several variables needs, to be made before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Pages(StatefulProcessor):
    """Last digests of a company's pages: a map by url, and that of the last page of any url."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "url string", "sha256 string", self.ttl_ms)
        self.last = handle.getValueState("last", "sha256 string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(["fetched_at", "id"])
        last = self.last.get()[0] if self.last.exists() else None
        changed = []
        for url, digest in zip(held["url"], held["sha256"]):
            if url is None or url != url:
                before = last
            else:
                # Only the urls of this micro-batch are read and written, whatever the company's others are.
                before = self.known.getValue((url,))[0] if self.known.containsKey((url,)) else None
                if before != digest:
                    self.known.updateValue((url,), (digest,))
            changed.append(before != digest)
            last = digest
        self.last.update((last,))
        yield held.assign(changed=changed)[["ico", "source", "url", "id", "changed"]]

    def close(self) -> None:
        pass


def page_changes(snapshots: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Stream of snapshots (ico, source, url, fetched_at, id, sha256) with ``changed`` against the one before.

    The one before is that of the same url; a snapshot without one compares with the last
    of any url, as the batch index does; snapshots within one micro-batch are taken by
    fetched_at, then id.  State is one entry for each url of a company, of which a
    micro-batch touches its own; entries that were not written for ``ttl_days`` are
    dropped, and such a page then counts as changed.  Needs STATE_STORE.
    """
    rows = snapshots.select("ico", "source", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "id", "sha256")
    return rows.groupBy("ico", "source").transformWithStateInPandas(
        statefulProcessor=_Pages(ttl_days and ttl_days * 86_400_000), outputStructType="ico string, source string, url string, id long, changed boolean", outputMode="Append", timeMode="ProcessingTime" if ttl_days else "None"
    )


def coverage(changes: DataFrame, sources: DataFrame, as_of: str, time_col: str = "ts") -> DataFrame:
    """source, records, reaches_to, retained_from, wanted_from, answer of each of ``sources``.

    ``sources`` have source, retained_from (the oldest day that the feed still holds), lag,
    cadence and width in days.  The window that a source is asked for begins ``width`` days
    before ``as_of``.  The answer is ``cannot`` where the window reaches past what is
    retained, or where lag and cadence together exceed the width, so that a record may come
    too late for its window, or where no record has come; else ``complete``.
    """
    seen = changes.groupBy("source").agg(F.count("*").alias("records"), F.max(F.col(time_col).cast("date")).alias("reaches_to"))
    wanted = F.date_sub(F.lit(as_of).cast("date"), F.col("width").cast("int"))
    rows = sources.join(seen, "source", "left").withColumn("records", F.coalesce("records", F.lit(0)).cast("long")).withColumn("wanted_from", wanted)
    past, slow = F.col("retained_from").cast("date") > F.col("wanted_from"), F.col("lag") + F.col("cadence") > F.col("width")
    return rows.select(
        "source", "records", "reaches_to", F.col("retained_from").cast("date").alias("retained_from"), "wanted_from",
        F.when(past | slow | (F.col("records") == 0), "cannot").otherwise("complete").alias("answer"), F.when(past, "not_retained").when(slow, "too_slow").when(F.col("records") == 0, "nothing_came").alias("why"),
    )


def with_late(changes: DataFrame, retained_from: str, time_col: str = "ts", metric: str = "coverage") -> DataFrame:
    """A stream with ``uncovered`` marks, and how many there were as metrics of each micro-batch's progress."""
    marked = flag_uncovered(changes, retained_from, time_col)
    return marked.observe(metric, F.count(F.lit(1)).alias("records"), F.count_if("uncovered").alias("uncovered"), F.max(F.col(time_col).cast("timestamp")).alias("newest"))
