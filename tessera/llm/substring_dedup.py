"""Suffix-array dedup: removing every byte of passages that occur more than once, by external induced sorting of shards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .anchors import gram_hashes, owners
from .common import small_batches, table_alone
from .suffixes import common_prefixes, suffix_order

#: Length of the content-picked grams that deal stretches to shards.
GRAM = 48
#: Words of the grams that deal passages of words.
WORD_GRAM = 8
#: A task sorts its groups in shards of about so many bytes; one group alone may be larger.
SHARD_BYTES = 3 << 20
#: Texts are joined up to about so many bytes, to hash their words at once.
HASH_BYTES = 1 << 20

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: By n: the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(row, own, content, start, n): runs of n starts of ``length``-byte stretches with one owner gram, with hashes of the owner and of the run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own, content, start, count = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _bytes(text.as_py())
                first, last, h = owners(np.frombuffer(data, np.uint8), length, GRAM)
                if len(first):
                    row.append(np.full(len(first), key))
                    own.append(h.view(np.int64))
                    content.append(np.array([xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64).view(np.int64))
                    start.append(first)
                    count.append(last - first + 1)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (row, own, content, start, count)], ["row", "own", "content", "start", "n"])

    return docs.select("row", "text").mapInArrow(run, "row long, own long, content long, start long, n long")


def _again(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each part starts when all are put together with a symbol behind each, and at which places ``length`` bytes begin that also begin elsewhere."""
    start = np.cumsum([0, *(len(p) + 1 for p in parts)])
    s = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    s[start[1:] - 1] = 0
    order = suffix_order(s, length)
    shared = common_prefixes(s, order)
    again = np.zeros(len(s), bool)
    like = np.flatnonzero(shared[order] >= length)  # this suffix and the one before it in order
    again[order[like]] = True
    again[order[like - 1]] = True
    return start, again


def repeated_starts(parts: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each part, which of its starts begin ``length`` bytes that also begin elsewhere; a part with copies is elsewhere too."""
    start, again = _again(parts, length)
    n = [max(0, len(p) - length + 1) for p in parts]
    return [again[a : a + m] if c < 2 else np.ones(m, bool) for a, m, c in zip(start.tolist(), n, copies)]


def repeated_runs(parts: list[bytes], copies: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last): the runs of ``repeated_starts`` in parts without copies. A run ends within its part, as a part's last ``length - 1`` places begin nothing so long."""
    start, again = _again(parts, length)
    first, behind = np.flatnonzero(np.diff(again.view(np.int8), prepend=0)).reshape(-1, 2).T
    of = np.searchsorted(start, first, "right") - 1
    single = np.array(copies)[of] < 2
    of = of[single]
    return of, first[single] - start[of], behind[single] - start[of] - 1


def may_repeat(owned: list[int], parts: list[bytes], length: int) -> np.ndarray:
    """Which of some parts may share ``length`` bytes with another part of their owner; no part has such bytes twice.

    Shared bytes have the owner gram, a part's first of that hash, at the same place. Of the bytes beside the gram, half or more lie on one side of it,
    so parts that share neither half with another have nothing to sort. The halves are compared as they are.
    """
    half = (length - GRAM + 1) // 2
    start = np.cumsum([0, *map(len, parts)])
    own = np.repeat(np.array(owned, np.int64).view(np.uint64), np.diff(start))
    h = gram_hashes(np.frombuffer(b"".join(parts), np.uint8), GRAM)
    hits = np.flatnonzero(h == own[: len(h)])
    of, first = np.unique(np.searchsorted(start, hits, "right") - 1, return_index=True)
    at = (hits[first] - start[of]).tolist()
    halves = []
    for i, p in zip(of.tolist(), at):
        if p >= half:
            halves.append((i, (owned[i], 0, parts[i][p - half : p + GRAM])))
        if p + GRAM + half <= len(parts[i]):
            halves.append((i, (owned[i], 1, parts[i][p : p + GRAM + half])))
    count = Counter(key for _, key in halves)
    out = np.zeros(len(parts), bool)
    out[[i for i, key in halves if count[key] > 1]] = True
    return out


def _sorted_shards(regions: DataFrame, length: int) -> DataFrame:
    """(own, content, first, last): runs of repeated starts in single regions; regions (own, content, copies, bytes) come in the order of own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            of, first, last = repeated_runs(parts, copies, length)
            if len(of):
                own, content = np.array(keys, np.int64)[of].T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, content, first, last)], ["own", "content", "first", "last"])

        def sift():
            for i in np.flatnonzero(may_repeat([own for own, _ in new_keys], new_parts, length)).tolist():
                keys.append(new_keys[i])
                parts.append(new_parts[i])
                copies.append(new_copies[i])
            return sum(map(len, parts))

        keys, parts, copies, new_keys, new_parts, new_copies, size = [], [], [], [], [], [], 0
        for batch in batches:
            for own, content, c, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if new_keys and new_keys[-1] == (own, content):  # a row that is in the table twice
                    continue
                if size >= SHARD_BYTES and new_keys[-1][0] != own:
                    if sift() >= SHARD_BYTES:
                        yield from flush()
                        keys, parts, copies = [], [], []
                    new_keys, new_parts, new_copies, size = [], [], [], 0
                new_keys.append((own, content))
                new_parts.append(data)
                new_copies.append(c)
                size += len(data)
        if new_keys and sift():
            yield from flush()

    return regions.mapInArrow(run, "own long, content long, first long, last long")


def repeated_passages(docs: DataFrame, length: int) -> DataFrame:
    """(row, first, last) byte ranges, ends included, that strings of ``length`` bytes with a second start cover; ``docs`` has (row, text).

    Equal stretches have equal owner grams, so stretches are grouped by owner: only groups with two occurrences can hold a repeat. Runs of
    stretches with equal bytes are one region with a count. Groups of several regions are dealt to tasks by owner; a task orders the
    suffixes of its groups, shard by shard, by induced sorting, and neighbours that share ``length`` bytes repeat. Regions that share no half of such a stretch with another
    of their group (``may_repeat``) are not sorted.
    """
    occ = table_alone(_stretches(docs, length), "sub-stretches")
    regions = occ.groupBy("own", "content").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n")).alias("at"))
    owner = regions.groupBy("own").agg(F.count("*").alias("regions"), F.sum("copies").alias("all")).filter("all > 1")
    regions = table_alone(regions.join(owner.select("own", "regions"), "own").select("own", "content", "copies", "regions", "at.*"), "sub-regions")
    wanted = regions.filter("regions > 1").groupBy("row").agg(F.collect_list(F.struct("own", "content", "copies", "start", "n")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, cuts in zip(batch.column(0), batch.column(1)):
                data, cuts = _bytes(text.as_py()), cuts.as_py()
                pieces = [data[c["start"] : c["start"] + c["n"] + length - 1] for c in cuts]
                yield pa.RecordBatch.from_arrays([*(pa.array([c[k] for c in cuts], pa.int64()) for k in ("own", "content", "copies")), pa.array(pieces, pa.binary())], ["own", "content", "copies", "bytes"])

    texts = docs.join(wanted, "row").select("text", "cuts")
    pieces = texts.mapInArrow(cut, "own long, content long, copies long, bytes binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = pieces.repartition(n, "own").sortWithinPartitions("own", "content")
    found = table_alone(_sorted_shards(shards, length), "sub-found")
    copied = occ.join(regions.filter("copies > 1").select("own", "content"), ["own", "content"]).select("row", "start", (F.col("start") + F.col("n") - 1).alias("end"))
    single = regions.filter("copies = 1").join(found, ["own", "content"]).select("row", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last")).alias("end"))
    return copied.unionByName(single).select("row", F.col("start").alias("first"), (F.col("end") + length - 1).alias("last"))


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words, A-Z lower-cased: of words up to 16 bytes from two integers, many texts at once; of longer ones by xxh3."""

    def flush():
        data = b" ".join(held).lower() + b" " * 17
        a = np.frombuffer(data, np.uint8)[:-16]
        edge = np.flatnonzero(np.diff((a == 32) | (a - np.uint8(9) < 5), prepend=True))
        start, end = edge[::2], edge[1::2]
        n = end - start
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # from each byte on
        h = (eight[start] & _FIRST[np.minimum(n, 8)]) * _ONE
        h ^= h >> np.uint64(32)
        h = (h + n.astype(np.uint64)) * _TWO
        h ^= h >> np.uint64(29)
        h = (h ^ (eight[start + 8] & _FIRST[np.clip(n - 8, 0, 8)])) * _ONE
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(n > 16).tolist():
            h[i] = xxh3_64_intdigest(data[start[i] : end[i]])
        return np.split(h, np.searchsorted(start, np.cumsum([len(x) + 1 for x in held[:-1]])))

    held, size = [], 0
    for text in texts:
        held.append(_bytes(text))
        size += len(held[-1])
        if size >= HASH_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)


def _word_runs(docs: DataFrame, size: int) -> DataFrame:
    """(row, own, content, start, n): runs of n starts of ``size``-word passages with one owner gram of words, with hashes of the owner and of the run's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own, content, start, count = [], [], [], [], []
            for key, h in zip(batch.column(0).to_pylist(), word_hashes(_texts(batch.column(1)))):
                first, last, o = owners(h, size, WORD_GRAM)
                if len(first):
                    data = memoryview(h).cast("B")
                    row.append(np.full(len(first), key))
                    own.append(o.view(np.int64))
                    content.append(np.array([xxh3_64_intdigest(data[8 * a : 8 * b]) for a, b in zip(first.tolist(), (last + size).tolist())], np.uint64).view(np.int64))
                    start.append(first)
                    count.append(last - first + 1)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (row, own, content, start, count)], ["row", "own", "content", "start", "n"])

    return docs.select("row", "text").mapInArrow(run, "row long, own long, content long, start long, n long")


def shared_passages(docs: DataFrame, size: int) -> DataFrame:
    """(row): documents with a passage of ``size`` words, A-Z lower-cased, that another document has too; ``docs`` has (row, text).

    As for bytes, equal passages have equal owner grams. A run of passages that two documents have in full settles both. Only groups with a document that this doesn't
    settle are compared passage by passage, by a hash of each, in a groupBy; a group is never gathered.
    """
    occ = table_alone(_word_runs(docs, size), "sub-word-runs")
    apart = lambda c: F.min(c) != F.max(c)
    regions = occ.groupBy("own", "content").agg(apart("row").alias("many"), F.min(F.struct("row", "start", "n")).alias("at"))
    regions = table_alone(regions.select("own", "content", "many", "at.*"), "sub-word-regions")
    alike = regions.groupBy("own").agg(F.count("*").alias("regions"), F.max("many").alias("many")).filter("regions > 1 OR many")
    settled = table_alone(occ.join(regions.filter("many").select("own", "content"), ["own", "content"], "left_semi").select("row").distinct(), "sub-word-settled")
    several = regions.join(alike.filter("regions > 1").select("own"), "own", "left_semi")
    unsettled = several.join(settled, "row", "left_anti").select("own").distinct()
    wanted = several.join(unsettled, "own", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, cuts in zip(batch.column(0).to_pylist(), word_hashes(_texts(batch.column(1))), batch.column(2).to_pylist()):
                h = gram_hashes(words, size)
                found = np.unique(np.concatenate([h[c["start"] : c["start"] + c["n"]] for c in cuts]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(found.view(np.int64))], ["row", "passage"])

    passages = docs.join(wanted, "row").select("row", "text", "cuts").mapInArrow(windows, "row long, passage long")
    passages = table_alone(passages, "sub-word-passages")
    both = passages.groupBy("passage").agg(apart("row").alias("many")).filter("many").select("passage")
    return settled.unionByName(passages.join(both, "passage", "left_semi").select("row")).distinct()


def substring_dedup(docs: DataFrame, length: int = 400, words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left, in order; binary), ``shared``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in another document or in the same. Strings never cross
    documents, overlaps count, and all is judged on the input. Null texts count as empty. Rows that repeat an id and text are two documents with equal
    texts, so long ones go whole; an empty table gives no rows. Other columns are ignored. Texts may be of any length, and ties don't arise.

    ``shared`` tells, apart from that, whether a passage of ``words`` words or more, which may have fewer bytes, is in another document too; copies of a
    row (equal id and text) count as one document there. It removes nothing.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    spans = repeated_passages(docs, length).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.join(shared_passages(docs, words).withColumn("shared", F.lit(True)), "row", "full_outer")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = _bytes(text.as_py())
                edges = np.zeros(len(data) + 1, np.int32)
                spans = spans.values if spans.is_valid else None
                if spans is not None:
                    np.add.at(edges, spans.field(0).to_numpy(), 1)
                    np.add.at(edges, spans.field(1).to_numpy() + 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                n_bytes.append(len(data))
                removed.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, runs)), pa.array(kept, pa.binary()), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "shared"])

    joined = docs.join(spans, "row", "left_outer").select("doc_id", "text", "spans", F.coalesce("shared", F.lit(False)).alias("shared"))
    return joined.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, shared boolean")
