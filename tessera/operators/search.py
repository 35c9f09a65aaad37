"""Top-k search: by keywords, by vectors, and both fused by rank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.functions.text import terms
from tessera.session import scratch_table

from .sparse import idf, term_frequencies

#: Constant of reciprocal rank fusion (Cormack, Clarke and Buettcher 2009), and how many times the limit each arm fetches.
RRF_K, PREFETCH = 60, 5
#: Scores are ranked at so many decimals, so that ties don't depend on the order of sums.
DECIMALS = 9
#: Scores of so many queries by so many points are held at once: 16 MB.
SCORE_ROWS = 1448
#: Up to so many rows, terms and weights of a table of queries are broadcast.
BROADCAST_ROWS = 500_000


def _check(k: int) -> None:
    if k <= 0:
        raise ValueError("the number of results must be positive")


def query_terms(spark: SparkSession, text: str) -> DataFrame:
    """(term, qtf) of a query."""
    return spark.createDataFrame([(text,)], "text string").select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))


def _weights(n: int, counts: dict, qtf: dict) -> Column:
    """Map literal from a query's term to qtf * idf."""
    found = [(t, float(qtf[t]), int(c)) for t, c in counts.items() if c]
    return F.create_map(*[x for t, q, c in found for x in (F.lit(t), q * idf(F.lit(n), F.lit(c)))]) if found else F.lit(None)


def keyword_scores(points: DataFrame, query: dict[str, int], keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, score) of the points that share a term with a query (term -> how often): sum of qtf * idf * tf. Keys tell points apart.

    The query's terms are literals, so a text is cut to them where it is scanned. One pass counts points and document frequencies, partially aggregated, and one
    scores; neither shuffles by file or term, and only a row of counts comes back between them.
    """
    hits = points.select(*keys, F.filter(terms(F.col(text)), lambda t: t.isin(*query)).alias("hits")) if query else points.select(*keys, F.array().cast("array<string>").alias("hits"))
    n, *df = hits.agg(F.count("*"), *[F.count_if(F.array_contains("hits", t)) for t in query]).first()
    weights = _weights(n, dict(zip(query, df)), query)
    score = F.aggregate("hits", F.lit(0.0), lambda acc, t: acc + F.element_at(weights, t)) if any(df) else F.lit(0.0)
    return hits.filter(F.size("hits") > 0).select(*keys, F.round(score, DECIMALS).alias("score"))


def array_scores(live: DataFrame, every: DataFrame, query: dict[int, float], keys: list[str], indices: str = "indices", values: str = "values", counted: tuple[int, dict[int, int]] | None = None) -> DataFrame:
    """``keyword_scores`` over stored sparse arrays of points, by index; document frequencies are those of ``every``, which isn't read where they are ``counted`` already (points, and points by index)."""
    if not query:
        return live.select(*keys, F.lit(0.0).alias("score")).limit(0)
    if counted:
        n, df = counted[0], [counted[1].get(i, 0) for i in query]
    else:
        n, *df = every.agg(F.count("*"), *[F.count_if(F.array_contains(indices, F.lit(i).cast("long"))) for i in query]).first()
    weights = _weights(n, dict(zip(query, df)), query)
    if not any(df):
        return live.select(*keys, F.lit(0.0).alias("score")).limit(0)
    hits = live.select(*keys, F.filter(F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("v")), lambda x: x["i"].isin(*query)).alias("hits")).filter(F.size("hits") > 0)
    return hits.select(*keys, F.round(F.aggregate("hits", F.lit(0.0), lambda acc, x: acc + F.element_at(weights, x["i"].cast("int")) * x["v"]), DECIMALS).alias("score"))


def keyword_batch(points: DataFrame, queries: DataFrame, keys: list[str], query_keys: list[str], text: str = "text") -> DataFrame:
    """(*query_keys, *keys, score) for a table of queries (*query_keys, term, qtf).

    A text's terms are counted in its row and cut to those of any query before anything shuffles. Terms and weights are broadcast up to BROADCAST_ROWS rows; beyond that they are joined, and
    AQE splits common terms.
    """
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    n = points.count()
    words = queries.select("term").distinct()
    hits = scratch_table(term_frequencies(points, keys, text).join(few(words), "term", "left_semi"), "hits")  # counted once, for frequencies and for scores
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = queries.join(df, "term").select(*query_keys, "term", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("w"))
    weights = few(weights) if queries.count() <= BROADCAST_ROWS else weights
    return hits.join(weights, "term").groupBy(*query_keys, *keys).agg(F.round(F.sum(F.col("w") * F.col("tf")), DECIMALS).alias("score"))


def vector_scores(points: DataFrame, query: Sequence[float], keys: list[str], vector: str = "dense") -> DataFrame:
    """(*keys, score): cosine with a literal query vector; a scan without a shuffle."""
    return points.select(*keys, F.round(vectors.cosine(F.col(vector), vectors.literal(query)), DECIMALS).alias("score"))


def top(scores: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best, ties by keys: each task keeps k rows."""
    _check(k)
    return scores.orderBy(F.desc("score"), *keys).limit(k)


def top_by(scores: DataFrame, k: int, group: Sequence[str], keys: list[str]) -> DataFrame:
    """The k best of each group, with their rank from 1."""
    _check(k)
    w = Window.partitionBy(*group).orderBy(F.desc("score"), *keys)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keep_best(top_score: np.ndarray, top_id: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's k so far and its new scores, ties by id: only what reaches a row's k-th score is sorted."""
    k = top_score.shape[1]
    score, at = np.hstack([top_score, score]), np.hstack([top_id, np.broadcast_to(ids, score.shape)])
    kth = np.partition(score, score.shape[1] - k, 1)[:, -k, None]
    row, col = np.nonzero(score >= kth)
    order = np.lexsort((at[row, col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - first[row] < k
    return score[row[keep], col[keep]].reshape(-1, k), at[row[keep], col[keep]].reshape(-1, k)


def nearest(points: DataFrame, queries: DataFrame, k: int, point_id: str, query_id: str, vector: str = "dense", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, point_id, rank, score): for each query (query_id, vector) its k nearest points by cosine, itself left out; ties by id.

    Queries go in blocks of about ``block_bytes``, the most that is broadcast at once; for each block one scan multiplies matrices and keeps k rows a query and task,
    so what shuffles is that, and not pairs. A task holds its block, k rows for each query of it, and SCORE_ROWS squared scores. Rows without a vector take no part. Ids are whole numbers.
    """
    _check(k)
    spark = points.sparkSession
    queries = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    n, dim = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * ((dim or 1) * 8) // block_bytes))
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect() if n else []
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in rows]), np.array([r["v"] for r in rows], np.float64)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            norms = np.sqrt((q * q).sum(1))
            top_score, top_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                for low in range(0, batch.num_rows, SCORE_ROWS):  # so many scores at once, whatever the numbers of queries and rows
                    part = batch.slice(low, SCORE_ROWS)
                    p, v = part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), np.float64)
                    size = np.sqrt((v * v).sum(1))
                    for at in range(0, len(ids), SCORE_ROWS):
                        rows = slice(at, at + SCORE_ROWS)
                        both = np.outer(norms[rows], size)
                        score = np.round(np.divide(q[rows] @ v.T, both, out=np.zeros_like(both), where=both > 0), DECIMALS)
                        score[ids[rows, None] == p[None, :]] = -np.inf  # itself
                        top_score[rows], top_id[rows] = keep_best(top_score[rows], top_id[rows], score, p)
            keep = top_score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(1))), pa.array(top_id[keep]), pa.array(top_score[keep])], [query_id, point_id, "score"])

        part = points.select(F.col(point_id).cast("long"), vector).filter(F.col(vector).isNotNull()).mapInArrow(best, f"{query_id} long, {point_id} long, score double")
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], f"{query_id} long, {point_id} long, score double")
    return top_by(out, k, [query_id], [point_id])


def fuse(arms: Sequence[DataFrame], k: int, keys: list[str], rank_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of arms that are already cut to their best: sum of 1 / (rank_k + rank), ranks from 1."""
    _check(k)
    # Arms hold PREFETCH * k rows, so a window over all of one is small.
    w = Window.orderBy(F.desc("score"), *keys)
    ranked = [a.select(*keys, (1.0 / (rank_k + F.row_number().over(w))).alias("part")) for a in arms]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return top(both.groupBy(*keys).agg(F.round(F.sum("part"), DECIMALS).alias("score")), k, keys)


def hybrid(keyword: DataFrame, dense: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Both arms' PREFETCH * k best, fused."""
    _check(k)
    return fuse([top(keyword, PREFETCH * k, keys), top(dense, PREFETCH * k, keys)], k, keys)
