"""The engine's inputs derived from the test tables, by rules that SQL can restate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of the queries.
NOW = "2024-06-01 00:00:00"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: section, rel_path, text, size, content_hash, mtime."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return d.select("doc_id", F.col("source").alias("section"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), "text", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"), day.alias("mtime"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as points of one chunk each, with a vector where vec_id = doc_id; every seventh is out of use."""
    f = files(spark, sf_dir)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    p = f.join(v, "doc_id", "left_outer")
    return p.select("doc_id", "section", F.col("rel_path").alias("source_file"), "text", "content_hash", F.lit(0).alias("page_number"), F.lit(0).alias("chunk_index"), (F.col("doc_id") % 7 != 3).alias("in_use"), "dense")


def chunk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as points: a conversation is a file, a turn a page and chunk; every eleventh turn is out of use."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("source_file"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("turn").cast("int").alias("chunk_index"), "text", ((F.col("conv_id") + F.col("turn")) % 11 != 5).alias("in_use"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of before, by doc_id mod 10: 0 is new (no row), 1 has changed, 2 had another path, 3 is an error, 4 was skipped, 5 is half
    ingested, 6 is marked for deletion, 7 is hidden, the others are as they were. Every fourth multiple of 10 is a file that went instead.
    """
    f = files(spark, sf_dir)
    m = F.col("doc_id") % 10
    s = f.filter((m != 0) | (F.col("doc_id") % 40 == 0)).select(
        "doc_id", "section",
        F.when(m == 2, F.concat(F.lit("old/"), F.col("rel_path"))).when(m == 0, F.concat(F.lit("gone_"), F.col("doc_id").cast("string"), F.lit(".txt"))).otherwise(F.col("rel_path")).alias("rel_path"),
        F.when(m.isin(0, 1), F.sha2(F.concat(F.lit("old"), F.col("doc_id").cast("string")), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(m == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime",
        (m + 1).cast("int").alias("total_chunks"), F.when(m == 5, 2).otherwise(m + 1).cast("int").alias("chunks_done"),
        (~m.isin(4, 6, 7)).alias("in_use"),
        F.when(m == 3, "error").when(m == 4, "skipped_size").when(m == 5, "ingesting").otherwise("ingested").alias("status"),
        F.when(m == 3, "broken").when(m == 4, "too_large").alias("error_reason"),
        F.when(m == 6, F.timestamp_seconds(F.lit(1_717_200_000) + (F.col("doc_id") % 7 - 3) * 86400)).alias("delete_after"),
    )
    return s
