"""Shared helpers: scratch tables in the cluster's shared folder, word hashing, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: The white space of all contracts: space, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch where the session keeps Spark's default of 10,000. Texts may be long, so batches are kept small.
BATCH_ROWS = 512

#: Bits of the map that tells which rows can't be in a set of ids: 4 MB, in 1,024 pieces.
MAYBE_BITS = 1 << 25


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table_alone(df: DataFrame, name: str) -> DataFrame:
    """``table``, whose shuffle files go as soon as it is written, not when the driver happens to collect its garbage; so disk holds those of one table at a time."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return table(df, name)
    finally:
        conf.set(key, before)


def drop(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: batches of at most ``BATCH_ROWS`` rows unless the session asks for its own size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def text_sha(text: Column) -> Column:
    """SHA-256 of a text as it is, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with ids that only rows of equal id and text share: {id, sha}, in the order of the ids, a null id first."""
    return docs.select(F.struct(F.col(id_col).alias("id"), text_sha(F.col(text_col)).alias("sha")).alias("doc_id"), F.col(text_col).alias("text"))


def maybe_in(docs: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """``docs`` with ``__maybe``: false only if ``key`` is not in the one column of ``ids`` (null is a value), so what has false needs no join.

    A map of ``MAYBE_BITS`` bits, by hash of the id, is broadcast in pieces of 4 kB; it stays as large whatever the number of ids, and only the share of rows that are wrongly true grows.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(MAYBE_BITS))
    piece, bit = (lambda c: F.bitmap_bucket_number(at(c))), (lambda c: F.bitmap_bit_position(at(c)))
    id_ = F.col(ids.columns[0])
    bits = ids.groupBy(piece(id_).alias("__piece")).agg(F.bitmap_construct_agg(bit(id_)).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (bit(key) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit(key) % 8 + 1).cast("int"))) != 0
    rows = docs.join(F.broadcast(bits), piece(key) == F.col("__piece"), "left_outer")
    return rows.select(*[docs[c] for c in docs.columns], F.coalesce(hit, F.lit(False)).alias("__maybe"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` but for those whose key (``keyed``) is in ``gone``; of rows that repeat id and text, one.

    Only rows whose id may be in ``gone`` are joined with it; the others' texts are neither hashed nor shuffled, unless ids repeat.
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    repeated = bool(ids.take(1))
    rows = maybe_in(docs, F.col(id_col), gone.select("doc_id.id"))
    gone = gone.select(F.col("doc_id.id").alias("__gone_id"), F.col("doc_id.sha").alias("__gone_sha"))
    maybe = rows.filter("__maybe").withColumn("__sha", text_sha(F.col(text_col)))
    left = maybe.join(gone, maybe[id_col].eqNullSafe(gone["__gone_id"]) & (maybe["__sha"] == gone["__gone_sha"]), "left_anti").select(*docs.columns)
    left = rows.filter("NOT __maybe").select(*docs.columns).unionByName(left)
    return left.withColumn("__sha", text_sha(F.col(text_col))).dropDuplicates([id_col, "__sha"]).drop("__sha") if repeated else left


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, filled as words appear; emptied at ``limit`` entries, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes. A function of the module, so that tasks share the worker's WORDS; an object named in a closure would be copied to each."""
    return WORDS.of(words)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z only, and split on the six white-space characters (what bytes.lower and bytes.split do)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``words_of`` has for each text, without an object for each word: all texts' words end to end, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words = lists.flatten()
    size = pc.binary_length(words).to_numpy()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and not size.all():  # a text without words is split into one empty word
        counts -= np.bincount(np.repeat(np.arange(len(counts)), counts)[size == 0], minlength=len(counts))
        words = words.filter(pa.array(size > 0))
    return words.cast(pa.binary()), counts


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
