"""Centroid clustering by Yinyang k-means: exact assignments, with one lower bound for each group of centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small_batches, table

#: Whole-number components are kept within these bounds, so that a squared distance in 64 dimensions is a long.
LARGEST = 1 << 27
#: Below this size products of components are exact in double, and matrices are multiplied by BLAS.
EXACT_DOUBLE = 1 << 22
#: Bounds are moved outward by this share and amount wherever they are rounded, so a bound never lies on the wrong side.
SLACK, LEAST = 1e-12, 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers, as longs: (rows of x, rows of c)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT_DOUBLE:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def groups_of(centroids: np.ndarray, n: int) -> np.ndarray:
    """The group of each centroid: ``n`` groups by a few rounds of k-means over the centroids themselves (there are k of them), from the first n."""
    seeds = centroids[:n].astype(np.float64)
    group = np.zeros(len(centroids), np.int64)
    for _ in range(5):
        group = ((centroids[:, None, :] - seeds) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (group == g).any():
                seeds[g] = centroids[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


def first_assignment(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper bound, lower bounds by group) of each row, by a whole scan; ties go to the smaller number."""
    d = squared(x, c)
    at = d.argmin(1)
    root = np.sqrt(d.astype(np.float64))
    upper = root[np.arange(len(x)), at] * (1 + SLACK) + LEAST
    root[np.arange(len(x)), at] = np.inf
    lower = np.stack([root[:, group == g].min(1, initial=np.inf) for g in range(group.max() + 1)], 1)
    return at, upper, lower * (1 - SLACK) - LEAST


def next_assignment(x: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids moved by ``drift``, scanning only what the bounds leave open.

    A row whose upper bound is under all its lower bounds keeps its centroid (global filter), first with the bound as it is and then with the exact distance; of the others, only groups
    whose lower bound isn't over the distance are scanned (group filter). Bounds must be apart to exclude, so ties are always scanned.
    """
    n, at = len(group), at.copy()
    upper = (upper + drift[at]) * (1 + SLACK) + LEAST
    far = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    lower = (lower - far) * (1 - SLACK) - LEAST
    open_ = np.flatnonzero(upper >= lower.min(1))
    if not len(open_):
        return at, upper, lower
    own = np.empty(len(open_), np.int64)
    for k in np.unique(at[open_]):
        rows = np.flatnonzero(at[open_] == k)
        own[rows] = squared(x[open_[rows]], c[k : k + 1])[:, 0]
    exact = np.sqrt(own.astype(np.float64))
    upper[open_] = exact * (1 + SLACK) + LEAST
    still = upper[open_] >= lower[open_].min(1)
    open_, own, exact = open_[still], own[still], exact[still]
    old, best, dist = at[open_], at[open_].copy(), own.copy()
    scan = lower[open_] <= upper[open_][:, None]
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(scan.shape[1]):
        rows, members = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
        if len(rows):
            d = squared(x[open_[rows]], c[members])
            found.append((g, rows, members, d))
            j = d.argmin(1)
            new, number = d[np.arange(len(rows)), j], members[j]
            better = (new < dist[rows]) | ((new == dist[rows]) & (number < best[rows]))
            dist[rows], best[rows] = np.where(better, new, dist[rows]), np.where(better, number, best[rows])
    low = lower[open_]
    left = np.flatnonzero(best != old)  # the centroid that was left bounds its group from now on
    low[left, group[old[left]]] = np.minimum(low[left, group[old[left]]], exact[left] * (1 - SLACK) - LEAST)
    for g, rows, members, d in found:
        root = np.where(members == best[rows][:, None], np.inf, np.sqrt(d.astype(np.float64)))
        low[rows, g] = root.min(1) * (1 - SLACK) - LEAST
    at[open_], lower[open_] = best, low
    upper[open_] = np.sqrt(dist.astype(np.float64)) * (1 + SLACK) + LEAST
    return at, upper, lower


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.ravel())


def _assign(dims: int, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's pass: vec_id, v and, but for the first round, what the round before left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("v"), dims)
            if drift is None:
                before = np.full(len(x), -1)
                at, upper, lower = first_assignment(x, centroids, group)
            else:
                before = batch.column("cluster").to_numpy()
                at, upper, lower = next_assignment(x, centroids, group, drift, before, batch.column("upper").to_numpy(), _rows(batch.column("lower"), group.max() + 1).copy())
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(before.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(upper), _lists(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "before", "cluster", "upper", "lower"])

    return run


def _moves(dims: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums: by cluster, how many vectors and which sums came, less those that went; k rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _rows(batch.column("v"), dims)
            for name, sign in (("cluster", 1), ("before", -1)):
                to = batch.column(name).to_numpy()
                for c in np.unique(to[to >= 0]):
                    n[c] += sign * (to == c).sum()
                    s[c] += sign * x[to == c].sum(0)
        some = np.flatnonzero(n.astype(bool) | s.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(s[some])], ["cluster", "n", "s"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "1:") -> DataFrame:
    """One row per vector that is kept: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid``.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; a component x counts as floor(scale * x), and beyond LARGEST as LARGEST. The first centroids are the k vectors
    whose ``salt`` + id has the least SHA-256 (a null id counts as empty; of rows of one id, the least vector first); with fewer vectors there are as many centroids. After ``rounds`` rounds of assignment and
    floor of the mean (an empty centroid stays) vectors are assigned once more. Distances are squared; ties go to the smaller number. A sum beyond long is null. Repeated rows count each; an empty
    table gives no rows; other columns are ignored.

    A round is one pass without a shuffle over a table that carries each vector's bounds, and sums of what changed its cluster, added up in tasks first: k rows a task are shuffled. The driver
    holds k centroids.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    d = d.filter((F.size("v") == dims) & F.forall("v", finite)).select("vec_id", whole.alias("v"))
    kind = d.schema["vec_id"].dataType.simpleString()
    sha = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = d.orderBy(sha, "v").limit(k).select("v").collect()  # k rows
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r["v"] for r in first], np.int64)
    group = groups_of(centroids, min(len(first), groups or max(1, k // 4)))
    counts, sums = [0] * len(first), [[0] * dims for _ in first]
    drift, state = None, None
    schema = f"vec_id {kind}, v array<long>, before int, cluster int, upper double, lower array<double>"
    for _ in range(rounds):
        new = table((d if state is None else state).mapInArrow(_assign(dims, centroids, group, drift), schema), "yinyang")
        if state is not None:
            drop(state)
        state = new
        moved = state.filter("cluster <> before").select("v", "before", "cluster").mapInArrow(_moves(dims, len(first)), "cluster int, n long, s array<long>")
        for r in moved.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s")).collect():  # k rows
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + b for a, b in zip(sums[r["cluster"]], r["s"])]
        moved_to = np.array([[x // n for x in s] if n else list(old) for n, s, old in zip(counts, sums, centroids)], np.int64)
        drift = np.sqrt(((moved_to - centroids).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        centroids = moved_to

    again, last = _assign(dims, centroids, group, drift), centroids

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in again(batches):
            x, at = _rows(batch.column("v"), dims), batch.column("cluster").to_numpy()
            distance = np.empty(len(x), np.int64)
            for c in np.unique(at):
                distance[at == c] = squared(x[at == c], last[c : c + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = table((d if state is None else state).mapInArrow(finish, f"vec_id {kind}, cluster int, distance long"), "yinyang-out")
    if state is not None:
        drop(state)
    per = {r["cluster"]: r["i"] for r in out.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("i")).collect()}  # k rows
    total = None if None in per.values() or sum(per.values()) >= 1 << 63 else sum(per.values())
    info = spark.createDataFrame([(c, i, total, [int(x) for x in centroids[c]]) for c, i in per.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
