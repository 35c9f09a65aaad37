"""Posting lists in blocks with their largest frequencies, and exact top-k that reads only blocks that can still matter.

Points are numbered where they are scanned and lie in ranges of ``RANGE`` numbers. A posting row is a term in a range: the numbers of the points that have the term, how often each has it, and the
largest of these frequencies. What a range's best point can score at most is the sum over a query's terms of weight times largest frequency, so a query first adds up these bounds from columns that hold no
postings, scores its most promising ranges, and then reads only ranges whose bound reaches the k-th best score so far.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import counted_terms

from .search import BROADCAST_ROWS, DECIMALS, _check
from .sparse import idf

#: Points in a range. A posting row holds at most so many postings, whatever the term.
RANGE = 1024
#: Points for each bucket of terms; a bucket is a folder, so that a query opens only files of its own terms.
POINTS_A_BUCKET = 20_000
#: Up to so many terms are literals of the scan's filter, which Parquet's statistics serve.
LITERAL_TERMS = 1000
POSTINGS = "term string, range long, n int, largest long, slots array<int>, counts array<long>"


@dataclass(frozen=True)
class PostingIndex:
    """What is written under ``path``: postings by bucket, and (range, slot, *keys) of the points. ``points`` is how many there are."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    key_schema: str
    points: int
    buckets: int
    ranges_a_task: int

    # writing

    @staticmethod
    def build(points: DataFrame, path: str, keys: Sequence[str], text: str = "text", buckets: int | None = None, range_size: int = RANGE, counted: Column | None = None) -> PostingIndex:
        """Index a table of points under a new folder in ``path``. Null texts have no terms. ``counted``: an array of (term, tf), each term once, in place of the terms of a text. Frequencies are counted in the row. One shuffle: postings by ranges of (bucket, term, range), which splits frequent terms over tasks and files."""
        spark = points.sparkSession
        path = f"{path.rstrip('/')}/postings-{uuid.uuid4().hex}"
        # The numbers hang on how the scan is cut into tasks, so they are taken once, in a table, with the texts that they belong to.
        spot = {"task": F.spark_partition_id(), "range": F.expr(f"__n div {range_size}"), "slot": F.expr(f"CAST(__n % {range_size} AS INT)")}
        numbered = points.select(*keys, (F.col(text) if counted is None else counted).alias("__text"), F.monotonically_increasing_id().alias("__n")).withColumns(spot).drop("__n")
        numbered.write.partitionBy("task").parquet(f"{path}/points")
        key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema)
        numbered = spark.read.schema(numbered.select("__text", "range", "slot").schema).parquet(f"{path}/points")
        n = numbered.count()
        buckets = buckets or max(8, -(-n // POINTS_A_BUCKET))
        if counted is None:
            counted = counted_terms(F.col("__text"))
        else:
            counted = F.col("__text")
        # a range's points lie in one file, so its lists are made where it is read; one that is cut between two tasks has two rows for a term, whose slots and bounds add up
        lists = numbered.select("range", "slot", counted.cast("array<struct<term:string,tf:bigint>>").alias("t")).mapInArrow(_lists, POSTINGS)
        lists = _written(lists.select(F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int").alias("bucket"), "*"), f"{path}/work")  # whose ranges are sampled before they are dealt
        lists.repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
        meta = {"keys": list(keys), "key_schema": key_schema, "points": n, "buckets": buckets, "ranges_a_task": (1 << 33) // range_size}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")
        return PostingIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> PostingIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return PostingIndex(spark, path, tuple(meta["keys"]), meta["key_schema"], meta["points"], meta["buckets"], meta["ranges_a_task"])

    # reading

    def postings(self, words: Sequence[str] | None = None) -> DataFrame:
        """Posting rows; with ``words``, of the folders and row groups that can hold them only."""
        if words is None:
            return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        return self._folders(POSTINGS, "postings/bucket", {zlib.crc32(w.encode()) % self.buckets for w in words}).filter(F.col("term").isin(*words))

    def _folders(self, schema: str, name: str, numbers: set[int]) -> DataFrame:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [f for f in (f"{self.path}/{name}={b}" for b in sorted(numbers)) if fs.exists(fs_path(f))]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _named(self, ranges: list[int] | None) -> DataFrame:
        """(*keys, range, slot) of the points; of some ranges, from the files of the tasks that numbered them."""
        schema = f"{self.key_schema}, range long, slot int"
        if ranges is None:
            return self.spark.read.schema(schema).parquet(f"{self.path}/points")
        return self._folders(schema, "points/task", {r // self.ranges_a_task for r in ranges}).filter(F.col("range").isin(*ranges))

    def search(self, query: dict[str, int], k: int, counted: tuple[int, dict[str, int]] | None = None) -> DataFrame:
        """(*keys, score) of the k best points for a query (term -> how often); ties by keys. As of ``keyword_scores`` over all indexed points; ``counted``: with these numbers of points, in all and by term, in place of the index's own."""
        queries = self.spark.createDataFrame([(0, t, q) for t, q in query.items()], "__q int, term string, qtf long")
        best = self.search_all(queries, k, ["__q"], counted)
        return best.orderBy(F.desc("score"), *self.keys).select(*self.keys, "score")

    def search_all(self, queries: DataFrame, k: int, query_keys: Sequence[str], counted: tuple[int, dict[str, int]] | None = None) -> DataFrame:
        """(*query_keys, *keys, rank, score): for each query of a table (*query_keys, term, qtf), its k best points, ties by keys.

        Sums of bounds shuffle by query and range, and hold no postings. Two rounds are read: the ranges of the highest bounds, enough to hold k points of each query; then those whose
        bound reaches the k-th score found. Equal scores are kept until keys have ordered them.
        """
        _check(k)
        q = list(query_keys)
        few = queries.count() <= BROADCAST_ROWS
        hint = F.broadcast if few else (lambda df: df)
        words = sorted(r[0] for r in queries.select("term").distinct().limit(LITERAL_TERMS + 1).collect())
        lists = self.postings(words if len(words) <= LITERAL_TERMS else None)
        asked = lists.join(hint(queries.select("term").distinct()), "term", "left_semi")
        df = asked.groupBy("term").agg(F.sum("n").alias("df")) if counted is None else self.spark.createDataFrame(list(counted[1].items()), "term string, df long")
        weights = queries.join(df, "term").select(*q, "term", (F.col("qtf") * idf(F.lit(self.points if counted is None else counted[0]), F.col("df"))).alias("w"))
        weights = _written(weights, f"{self.path}/work")
        bounds = lists.join(hint(weights), "term").groupBy(*q, "range").agg(F.sum(F.col("w") * F.col("largest")).alias("bound"), F.max("n").alias("n"))
        bounds = _written(bounds, f"{self.path}/work")
        # The n points that a range has for one term all score, so ranges with k of them in all are enough for k scores.
        by_bound = Window.partitionBy(*q).orderBy(F.desc("bound"), "range")
        before = F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        head = bounds.withColumn("__rank", F.row_number().over(by_bound)).filter(F.col("__rank") <= k).withColumn("__before", before).filter(F.col("__before") < k).select(*q, "range")
        first = _written(self._scores(lists, weights, head, q, hint), f"{self.path}/work")
        kth = first.withColumn("__rank", F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("score")))).filter(F.col("__rank") == k).select(*q, F.col("score").alias("kth"))
        rest = bounds.join(head, [*q, "range"], "left_anti").join(kth, q, "left_outer").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0 ** (1 - DECIMALS))).select(*q, "range")
        scores = first.unionByName(self._scores(lists, weights, rest, q, hint))
        tied = scores.withColumn("__rank", F.rank().over(Window.partitionBy(*q).orderBy(F.desc("score")))).filter(F.col("__rank") <= k).drop("__rank")
        tied = _written(tied, f"{self.path}/work")
        some = [r[0] for r in tied.select("range").distinct().limit(LITERAL_TERMS + 1).collect()]
        named = tied.join(self._named(some if len(some) <= LITERAL_TERMS else None), ["range", "slot"])
        order = Window.partitionBy(*q).orderBy(F.desc("score"), *self.keys)
        return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*q, *self.keys, "rank", "score")

    def _scores(self, lists: DataFrame, weights: DataFrame, ranges: DataFrame, q: list[str], hint) -> DataFrame:
        """(*q, range, slot, score) of all points of some ranges (*q, range). Few ranges are literals too, which Parquet's page index serves."""
        some = ranges.select("range").distinct().limit(LITERAL_TERMS + 1).collect()
        if len(some) <= LITERAL_TERMS:
            lists = lists.filter(F.col("range").isin(*[r[0] for r in some])) if some else lists.limit(0)
            ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
        hits = lists.join(hint(weights), "term").join(ranges, [*q, "range"], "left_semi").select(*q, "range", "w", F.explode(F.arrays_zip("slots", "counts")).alias("p"))
        return hits.groupBy(*q, "range", F.col("p.slots").alias("slot")).agg(F.round(F.sum(F.col("w") * F.col("p.counts")), DECIMALS).alias("score"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTINGS rows of (range, slot, t: array of term and tf). The last range of a batch waits for the next one, so a task holds a batch and a range."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        ranges = table.column("range").to_numpy()
        if not len(ranges):
            continue
        last = ranges == ranges[-1]
        if not last.all():
            yield from _listed(table.filter(pa.array(~last)))
        held = table.filter(pa.array(last))
    if held is not None:
        yield from _listed(held)


def _listed(points: pa.Table) -> Iterator[pa.RecordBatch]:
    """The postings of some points: sorted by range, term and slot as numbers, and cut where range or term changes."""
    t = points.column("t").combine_chunks()
    t = t if isinstance(t, pa.ListArray) else t.chunk(0)
    sizes = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
    flat = t.flatten()
    if not len(flat):
        return
    terms, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy(zero_copy_only=False)
    code = terms.indices.to_numpy(zero_copy_only=False)
    of, slot = (np.repeat(points.column(c).to_numpy(), sizes) for c in ("range", "slot"))
    order = np.lexsort((slot, code, of))
    code, of, slot, tf = code[order], of[order], slot[order], tf[order]
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])])
    ends = pa.array(np.r_[start, len(code)], pa.int32())
    columns = [terms.dictionary.take(pa.array(code[start])), pa.array(of[start]), pa.array(np.diff(np.r_[start, len(code)]), pa.int32()), pa.array(np.maximum.reduceat(tf, start), pa.int64())]
    columns += [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((slot, pa.int32()), (tf, pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTINGS.split(", ")])


def _written(df: DataFrame, folder: str) -> DataFrame:
    """A table of its own, so that what two later steps need is found once."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
