"""A corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of ``documents``, but for the last.  ``run`` writes every stage's
rows as Parquet into the shared folder and reads them as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import line_dedup, near_dup, packing, quality, toxicity
from leadloom.llm.queries import LINE_RATIO, remainder, table, tokenizer_path
from leadloom.llm.store import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.score(docs, model, score_col="__score").where("__score >= 0.5").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field doesn't find toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.tag_documents(docs, model).where("toxicity < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; n_chars follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, ratio=LINE_RATIO)
    return cleaned.withColumn("n_chars", F.col("kept_chars")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, repeated and null ids told apart by their texts."""
    return near_dup.one_of_each(docs, width=5).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dup", one_of_each),
    ("packing", pack),
]

#: Trained models, MinHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
