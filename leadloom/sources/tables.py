"""Landed files to tables and back: explicit schemas, last row wins, upserts, contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadloom.functions import text as X

REGISTER_COLUMNS = ("ICO", "FIRMA", "KATPO", "NACE", "NACE2025", "FORMA", "OKRESLAU", "DDATZAN", "OBEC_TEXT", "ICZUJ", "PSC", "ULICE_TEXT", "CDOM")


def read_register(spark: SparkSession, path: str, columns: Sequence[str] = REGISTER_COLUMNS) -> DataFrame:
    """The bulk register: CSV with a header, every column a string, empty text as null."""
    header = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(h.lstrip("﻿"), StringType()) for h in header])
    table = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    missing = [x for x in columns if x not in schema.names]
    if missing:
        raise ValueError(f"columns not in the file: {', '.join(missing)}")
    return table.select(*[F.nullif(F.col(x), F.lit("")).alias(x) for x in columns])


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """level, code, text, parent of a classification."""
    return read_register(spark, path, ("UROVEN", "CHODNOTA", "TEXT", "NADVAZ")).select(
        F.col("UROVEN").cast("int").alias("level"), F.col("CHODNOTA").alias("code"), F.col("TEXT").alias("text"), F.col("NADVAZ").alias("parent")
    )


def read_lines(spark: SparkSession, path: str, schema: StructType | str, error_col: str = "error") -> DataFrame:
    """JSON lines under a schema; half-written lines and error rows are left out."""
    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = StructType([*parsed.fields, StructField(error_col, StringType()), StructField("_corrupt_record", StringType())])
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col(error_col).isNull()).select(*parsed.names)


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``; a struct maximum, so partial per task."""
    rest = [x for x in rows.columns if x not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], *rest)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{x}").alias(x) for x in rest]).select(*rows.columns)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: rows whose key has no row in ``done``."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of known keys replaced; new keys are not inserted."""
    known = updates.join(base.select(key).distinct(), key, "left_semi")
    return base.join(known.select(key), key, "left_anti").unionByName(known.select(*base.columns))


def write_version(table: DataFrame, folder: str, version: str) -> str:
    """A version folder of its own; readers move to it only once it is complete."""
    path = f"{folder.rstrip('/')}/version={version}"
    table.write.mode("error").parquet(path)
    return path


def require(table: DataFrame, least_rows: int, columns: Sequence[str] = ()) -> DataFrame:
    """The table itself if it meets its contract; a cut-off input raises."""
    missing = [x for x in columns if x not in table.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    found = table.limit(least_rows).count()
    if found < least_rows:
        raise ValueError(f"only {found} rows, {least_rows} expected")
    return table


def flatten_vacancies(export: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Nested export (array ``items``) to one row per vacancy of the wanted companies."""
    rows = export.select(F.inline("items"))
    rows = rows.withColumn("ico", X.company_key("ico")).withColumn("posted", X.iso_day("posted"))
    return rows.join(keys.select("ico"), "ico", "left_semi") if keys is not None else rows


def store_snapshots(rows: DataFrame, blobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Index rows with digest and changed flag, and the texts not stored yet.

    ``rows``: id, ico, source, url, fetched_at, text.  A row has changed if its digest
    differs from that of the row before it of the same company, source and url; a null
    url compares with the row before of any url.
    """
    hashed = rows.withColumn("sha256", X.digest("text"))
    by_url = Window.partitionBy("ico", "source", "url").orderBy("fetched_at", "id")
    any_url = Window.partitionBy("ico", "source").orderBy("fetched_at", "id")
    before = F.when(F.col("url").isNull(), F.lag("sha256").over(any_url)).otherwise(F.lag("sha256").over(by_url))
    index = hashed.withColumn("changed", ~F.coalesce(before == F.col("sha256"), F.lit(False))).drop("text")
    fresh = hashed.groupBy("sha256").agg(F.min(X.normalise("text")).alias("text"))
    if blobs is not None:
        fresh = fresh.join(blobs.select("sha256"), "sha256", "left_anti")
    return index, fresh


def archive_documents(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One JSON text per key: its rows in a fixed order, so that equal rows give equal digests."""
    fields = [x for x in rows.columns if x != key]
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("rows"))
    return listed.select(key, F.to_json("rows").alias("document"))


def statement_totals(rows: DataFrame) -> DataFrame:
    """Turnover per statement: rows 1 and 2, in thousands; null if neither is there."""
    wanted = F.col("row").isin(1, 2)
    total = lambda x: F.sum(F.when(wanted, F.col(x))) * 1000
    return rows.groupBy("ico", "year").agg(total("current").alias("value_czk"), total("previous").alias("previous_czk"))


def labelled_fields(pages: DataFrame, label: str, value: str, names: dict[str, str], text_col: str = "html") -> DataFrame:
    """Label/value pairs of a page's markup as columns; the first value of a label wins."""
    labels = F.transform(F.regexp_extract_all(text_col, F.lit(label), F.lit(1)), X.normalise)
    values = F.transform(F.regexp_extract_all(text_col, F.lit(value), F.lit(1)), X.normalise)
    pairs = pages.withColumn("__labels", labels).withColumn("__values", values)
    at = lambda name: F.get(F.col("__values"), F.array_position("__labels", F.lit(name)).cast("int") - 1)
    return pairs.select(*pages.columns, *[F.when(F.array_contains("__labels", n), at(n)).alias(out) for n, out in names.items()])


def coalesce_fields(base: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with blank fields filled from ``other``."""
    side = other.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    filled = {x: F.coalesce(F.nullif(F.trim(F.col(x)), F.lit("")), F.nullif(F.trim(F.col(f"__{x}")), F.lit(""))) for x in columns}
    return base.join(side, key, "left").select(*[filled[x].alias(x) if x in filled else F.col(x) for x in base.columns])



def read_statement(spark: SparkSession, path: str, row_tag: str, row: str, current: str, previous: str) -> DataFrame:
    """Rows of filed statements: number, current and previous value from a row element's attributes."""
    schema = StructType([StructField(f"_{x}", StringType()) for x in (row, current, previous)])
    rows = spark.read.format("xml").schema(schema).option("rowTag", row_tag).option("attributePrefix", "_").load(path)
    number = lambda name: F.col(f"_{name}").try_cast("long")
    return rows.select(number(row).alias("row"), number(current).alias("current"), number(previous).alias("previous"))
