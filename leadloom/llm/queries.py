"""The operators of this subpackage applied to whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunked_bpe, embedding_dup, fingerprints, html_text, line_dedup, media, merkle, near_dup, packing, periodic_runs, quality, toxicity

#: The site-relative frequency above which a line is boilerplate, in ``op9`` and the pipeline.
LINE_RATIO = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.format_conversations(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    tagged = toxicity.tag_documents(docs.select("doc_id", "text"), model)
    return tagged.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans")
    )


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=LINE_RATIO)
    return cleaned.select("doc_id", "dropped_lines", "kept_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of ``docs``; of each tenth of the ids, by crc32, the words from one on repeat with a period."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def edited(w: Column) -> Column:
        n, g = F.size(w), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")
        first = (g % n).cast("int")
        period = 1 + F.floor((n - first) / (3 + g % 8)).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < first, i).otherwise(first + (i - first) % period))))

    # One variable for the words: an expression named in a lambda is computed once.
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, edited(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(crc % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    return (
        found.withColumn("best", best)
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", periodic_runs.as_text(F.col("runs")).alias("listed"), "collapsed")
        .select(
            "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
            F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with one more character claimed for each seventh id, by crc32."""
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"n_chars": F.col("n_chars") + 1}, where=remainder(7) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html,
    "op2_quality": quality_scores,
    "op3_media": media_columns,
    "op4_packing": packed,
    "op5_chat": chats,
    "op6_toxicity": toxicity_scores,
    "op7_bpe": bpe,
    "op8_near_dup": near,
    "op9_line_dedup": lines,
    "op10_fingerprints": prints,
    "op11_embedding_dup": links,
    "op12_periodic_runs": periodic,
    "op13_merkle": proofs,
}


def line_dedup_sql(source: str = "documents", ratio: float = LINE_RATIO) -> str:
    """doc_id, text (cleaned), dropped_lines of the rows of ``source``."""
    return f"""
      SELECT d.doc_id, d.lang, d.source, d.n_chars,
             array_to_string(list_transform(list_filter(list_transform(string_split(d.text, chr(10)), lambda x: {{'l': x, 'd': trim(x, ' ') <> '' AND list_contains(coalesce(b.drops, []), trim(x, ' '))}}), lambda s: NOT s.d), lambda s: s.l), chr(10)) AS text,
             len(list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') <> '' AND list_contains(coalesce(b.drops, []), trim(x, ' ')))) AS dropped
      FROM {source} d LEFT JOIN (
        SELECT source, list(line) AS drops FROM (
          SELECT c.source, c.line FROM (
            SELECT source, line, count(*) AS pages FROM (
              SELECT DISTINCT rid, source, line FROM (
                SELECT rowid_ AS rid, source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM (SELECT *, row_number() OVER () AS rowid_ FROM {source}))
              WHERE line <> '') GROUP BY source, line) c
          JOIN (SELECT source, count(*) AS total FROM {source} GROUP BY source) t ON c.source IS NOT DISTINCT FROM t.source
          WHERE c.pages / t.total > {ratio} AND c.pages > 1) GROUP BY source) b
      ON d.source IS NOT DISTINCT FROM b.source"""


ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": f"SELECT doc_id, CAST(coalesce(dropped, 0) AS INTEGER) AS dropped_lines, CAST(coalesce(length(text), 0) AS BIGINT) AS kept_chars, md5(text) AS text_md5 FROM ({line_dedup_sql()})",
}
