"""The company index as files: one folder a division, rows of a file in order of their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_index(companies: DataFrame, folder: str, by: str = "division", key: str = "ico") -> None:
    """Write or replace the divisions that ``companies`` has; other divisions of ``folder`` stay as they are.

    Ranges of (division, key) go to tasks, so that a division with most companies is spread over
    several files, and a file's key ranges let a reader skip it.
    """
    ordered = companies.repartitionByRange(by, key).sortWithinPartitions(by, key)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def read_index(spark: SparkSession, folder: str, schema: StructType, divisions: Sequence[str] = (), keys: Sequence[str] = (), by: str = "division", key: str = "ico") -> DataFrame:
    """Companies of the index, of some divisions or keys where they are named: only those folders and row groups are read."""
    rows = spark.read.schema(schema).parquet(folder)
    if divisions:
        rows = rows.where(F.col(by).isin(*divisions))
    return rows.where(F.col(key).isin(*keys)) if keys else rows
