"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keyed, table, without

#: Up to so many surviving (length, prefix hash) keys, 16 bytes each, are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 500_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digests: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept`` and, with ``digests``, ``text_sha256``.

    Texts are equal when identical without white space. Of equal texts the row with the most code points, then the
    smallest id (null sorts first), stays. Rows are refined in three steps, and only what still has a possible equal goes on:
    rows that share the normalised length, then also the hash of a prefix, then also SHA-256 of the whole. Unless
    ``digests`` asks for every row's SHA-256, contents beyond the prefix are hashed only for groups that survive two steps.

    Null texts count as empty; empty texts are equal to each other. Rows that repeat an id and text are copies with
    the same id: they have one keep_id and all say kept (``keep_exact`` then leaves one). An empty table gives no rows.
    Other columns are ignored, so their names can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, SPACES, "")
    digest = F.sha2(bare, 256)
    shape = [F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), F.length(bare).alias("len"), F.xxhash64(F.substring(bare, 1, prefix_chars)).alias("prefix")]
    rows = table(docs.select(*shape, *([digest.alias("sha")] if digests else [])), "exact-rows")
    lengths = rows.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len")
    keys = rows.join(lengths, "len", "left_semi").groupBy("len", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("len", "prefix")
    if digests:
        alike = rows.join(keys, ["len", "prefix"], "left_semi")
    else:
        keys = table(keys, "exact-keys")
        few = keys.count() <= BROADCAST_KEYS
        full = docs.select(*shape, bare.alias("bare")) if few else docs.select(*shape, digest.alias("sha"))
        alike = full.join(F.broadcast(keys) if few else keys, ["len", "prefix"], "left_semi")
        if few:
            alike = alike.withColumn("sha", F.sha2("bare", 256)).drop("bare")
        alike = table(alike.select("doc_id", "chars", "len", "prefix", "sha"), "exact-alike")
    groups = (
        alike.groupBy("len", "prefix", "sha")
        .agg(F.count("*").alias("size"), F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").alias("id"))).alias("first"))
        .filter("size > 1")
        .select("len", "prefix", "sha", "size", F.col("first.id").alias("first_id"))
    )
    if digests:
        out = rows.join(groups, ["len", "prefix", "sha"], "left_outer")
    else:
        out = alike.join(groups, ["len", "prefix", "sha"])
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *([F.col("sha").alias("text_sha256")] if digests else []))
    return out


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts.

    Rows are told apart by id and text, so null and repeated ids lose no text; of rows that repeat both, one stays.
    """
    return without(docs, table(exact_dedup(keyed(docs, id_col, text_col)).filter("not kept").select("doc_id").distinct(), "exact-dropped"), id_col, text_col)
