"""Token-ID output in training order: a keyed permutation of sequences, written as fixed-stride binary shards."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import drop, scratch_dir, small_batches, table

#: A record's header: slot (8 bytes), id of the document that the sequence begins in (8), ids held (4), documents that begin in it (4). Then come ids of
#: 2 bytes, zero behind the last, and one byte 0x0A. All numbers are little-endian. Records have one length: record k of a shard begins at k * stride.
HEADER = struct.Struct("<qqii")
ROUNDS = 6


def pack(slot: int, doc_id: int | None, held: int, begun: int, ids: bytes) -> bytes:
    """A record without its last byte."""
    return HEADER.pack(slot, -(1 << 63) if doc_id is None else doc_id, held, begun) + ids


def unpack(record: bytes) -> tuple[int, int | None, int, int, bytearray]:
    slot, doc, held, begun = HEADER.unpack_from(record)
    return slot, None if doc == -(1 << 63) else doc, held, begun, bytearray(record[HEADER.size : HEADER.size + 2 * held])


@dataclass(frozen=True)
class Shards:
    """What a reader needs: the folder, ids in a sequence, sequences in a shard, and sequences in all."""

    path: str
    length: int
    per_shard: int
    sequences: int

    @property
    def stride(self) -> int:
        return HEADER.size + 2 * self.length + 1


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed Feistel permutation of [0, n) at ``x``: rounds alternate between the two halves of as many bits as n needs, and
    values that fall outside [0, n) are permuted again until they fall inside (cycle-walking). The network is a permutation of
    under 2 n values, so each cycle that starts inside comes back inside, after 2 steps on average.
    """
    bits = max(2, (n - 1).bit_length())
    low = np.uint64(bits // 2)
    low_mask, high_mask = np.uint64((1 << (bits // 2)) - 1), np.uint64((1 << (bits - bits // 2)) - 1)

    def scramble(v: np.ndarray, r: int) -> np.ndarray:
        digest = hashlib.blake2b(f"{key}:{r}".encode(), digest_size=16).digest()
        a, b = (np.uint64(int.from_bytes(digest[i : i + 8], "little") | 1) for i in (0, 8))
        v = (v + b) * a
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(29))) * a
        return v ^ (v >> np.uint64(32))

    def once(v: np.ndarray) -> np.ndarray:
        high, rest = v >> low, v & low_mask
        for r in range(ROUNDS):
            if r % 2:
                rest = rest ^ (scramble(high, r) & low_mask)
            else:
                high = high ^ (scramble(rest, r) & high_mask)
        return high << low | rest

    out = once(np.asarray(x, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


_encoders: dict[int, object] = {}


def encoder_for(ranks: bytes, pattern: str):
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        _encoders.clear()
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("tessera", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
    return _encoders[key]


def sequences(docs: DataFrame, ranks_path: str, pattern: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (docs, held, begun, ids): a task's documents end to end, an end id behind each, cut into sequences of ``length``; its last one is shorter.

    docs lists the documents that have ids in the sequence, begun counts those that begin in it, and ids are little-endian uint16.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(ranks, pattern)
        kept: list[tuple[int | None, np.ndarray, bool]] = []  # (document, ids, whether it begins here) of the sequence in the making
        room, out = length, []

        def close() -> None:
            nonlocal kept, room
            out.append(([d for d, _, _ in kept], length - room, sum(b for _, _, b in kept), np.concatenate([x for _, x, _ in kept]).tobytes()))
            kept, room = [], length

        def rows() -> pa.RecordBatch:
            d, h, b, x = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(d, pa.list_(pa.int64())), pa.array(h, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], ["docs", "held", "begun", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, at = np.array([*enc.encode_ordinary(text.as_py() or ""), end_id], np.uint16), 0
                while at < len(ids):
                    part = ids[at : at + room]
                    kept.append((doc_id, part, not at))
                    at, room = at + len(part), room - len(part)
                    if not room:
                        close()
            if out:
                yield rows()
        if kept:
            close()
            yield rows()

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "docs array<long>, held int, begun int, ids binary")


def write_shards(docs: DataFrame, ranks_path: str, pattern: str, path: str | None = None, length: int = 2048, end_id: int = 50256, per_shard: int = 1024, key: int = 20240601, **columns) -> Shards:
    """Tokenise ``docs`` and write its sequences in training order.

    Sequences are numbered densely in the order of the table's files and rows (from counts by file, so nothing is sorted for it).
    A keyed permutation gives each number its slot. Shard k holds the slots from k * per_shard: rows are dealt by ranges of slots, so one task writes whole
    shards, in order, each as one file under ``shard=k``. Spark's text writer commits the files, so lost tasks leave no half shard; it
    writes bytes as they are, and its line end is the record's last byte. A rerun over the same files gives the same shards.

    Ids are compressed where they wait (in the table of sequences, and in the shuffle), and plain in the shards. The documents of each sequence are
    also kept in a small table beside the shards.

    Ids of documents are whole numbers; a null id is written as the least long. Null and empty texts give the end id
    alone. Repeated rows are written each. An empty table gives no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = table(sequences(docs, ranks_path, pattern, length, end_id, **columns), "sequences", compression="zstd")
    at = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "*")
    # Counts by file: one row a file, so its window over all rows is small.
    files = at.groupBy("file").agg(F.count("*").alias("count"))
    name = F.substring_index("file", "/", -1)
    files = table(files.select("file", F.coalesce(F.sum("count").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), "count"), "sequence-files")
    n = files.agg(F.sum("count")).first()[0] or 0
    shards = Shards(path, length, per_shard, n)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = permute(b.column(0).to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), b.column(1), b.column(2), b.column(3), pa.array([zlib.compress(x, 9) for x in b.column(4).to_pylist()], pa.binary())], ["shard", "slot", "doc", "held", "begun", "ids"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [pack(s, d, h, k, zlib.decompress(x).ljust(2 * length, b"\0")) for s, d, h, k, x in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["shard", "record"])

    seq = at.join(files, "file").select((F.col("first") + F.col("row")).alias("seq"), F.col("docs")[0].alias("doc"), "held", "begun", "ids")
    dealt = seq.mapInArrow(numbered, "shard long, slot long, doc long, held int, begun int, ids binary")
    tasks = max(1, min(-(-n // per_shard), 100_000))
    count = max(1, -(-n // per_shard))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") * tasks / count).cast("int")).sortWithinPartitions("shard", "slot")  # ranges of slots, known beforehand
    lines = dealt.mapInArrow(records, "shard long, record binary")
    lines.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    number = F.pandas_udf(lambda x: pd.Series(permute(x.to_numpy(), n, key)), LongType())
    at.join(files, "file").select(number(F.col("first") + F.col("row")).alias("slot"), "docs").write.parquet(f"{path}/_documents")
    meta = spark.createDataFrame([(json.dumps(asdict(shards)),)], "value string")
    meta.coalesce(1).write.text(f"{path}/_meta")  # readers skip names that begin with _
    if n:
        drop(rows)
    return shards


def read_shards(spark: SparkSession, shards: Shards, first_slot: int = 0) -> DataFrame:
    """Rows (slot, shard, byte_offset, doc_id, n_tokens, begun, ids) from ``first_slot`` on: whole shards before it are never opened.

    Fixed-length records let Spark split files at any record, so reading is sequential within a task and resumes at any slot.
    """
    count, per = -(-shards.sequences // shards.per_shard), shards.per_shard
    schema = "slot long, shard long, byte_offset long, doc_id long, n_tokens int, begun int, ids binary"
    if first_slot >= shards.sequences:
        return spark.createDataFrame([], schema)
    first = first_slot // per
    # a glob for all, a list for what is left of a resumed read
    paths = f"{shards.path}/shard=*" if not first else ",".join(f"{shards.path}/shard={k}" for k in range(first, count))
    stride = shards.stride

    def parse(records):
        for r in records:
            slot, doc, held, begun, ids = unpack(r)
            if slot >= first_slot:
                yield slot, slot // per, slot % per * stride, doc, held, begun, ids

    return spark.createDataFrame(spark.sparkContext.binaryRecords(paths, stride).mapPartitions(parse), schema, verifySchema=False)


def documents_of(spark: SparkSession, shards: Shards) -> DataFrame:
    """(slot, docs): the documents with ids in each sequence."""
    return spark.read.schema("slot long, docs array<long>").parquet(f"{shards.path}/_documents")
