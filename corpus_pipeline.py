"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, SentencePiece. Each stage takes all that the one before kept.

In every stage rows are told apart by id and text, so null and repeated ids lose no text; null texts count as empty; texts of any length are taken whole; an empty table
gives an empty one; columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.exact_dedup import keep_exact
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import keep_near
from tessera.llm.queries import public_tokenizer
from tessera.llm.sentencepiece_bpe import tokenize
from tessera.llm.toxicity import keep_clean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (a score of 0.5 or more). Empty texts are scored by the bias alone; repeated rows are scored each."""
    return keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of texts that are equal but for white space: the longest, of ties the one of smallest id (null first). Empty texts are equal; of repeated rows one stays."""
    return keep_exact(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each component of documents whose 5-word shingles have a similarity of 0.8 or more: that of smallest id (null first). Texts without words link with nothing; of repeated rows one stays."""
    return keep_near(docs.select(*COLUMNS), k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the curriculum says, in training order; ties in time go by id. Repeated rows hold their positions together; texts without words come where their source's stream passes them."""
    return mix(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that the mix takes, once for each time, and the hash of what they decode to. Empty texts have no ids."""
    out = tokenize(docs.select("doc_id", "text", "source"), public_tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL expresses neither the classifier, nor the hashed order of the mix, nor BPE; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over all others, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage-{name}")
    return docs
