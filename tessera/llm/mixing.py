"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_sha, word_count

#: Up to so many sources, their table is broadcast; beyond it the join shuffles and AQE splits hot sources.
BROADCAST_SOURCES = 10_000

#: Weight over training time as (time, factor) knots, dealt to the sources in turn. Each integrates to 1 over [0, 1].
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)))


def _table_of(shapes: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Array, by shape, of segments {t0, w0, slope, before}: before is the integral up to t0."""
    out = []
    for knots in shapes:
        total, segments = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            segments.append((t0, w0, (w1 - w0) / (t1 - t0), total))
            total += (w0 + w1) / 2 * (t1 - t0)
        if knots[0][0] != 0 or knots[-1][0] != 1 or abs(total - 1) > 1e-9 or min(w for _, w in knots) < 0:
            raise ValueError("a shape runs from time 0 to 1, is not negative and integrates to 1")
        out.append(F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(s, ("t0", "w0", "slope", "before"))]) for s in segments]))
    return F.array(*out)


def source_targets(rows: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """From (source, size) rows: ``source, docs, source_size, weight, rank, target``; targets are words.

    With sources by code point, null last, weights repeat. Targets share the sum of all sizes by weight; none is above
    ``max_repeat`` times its source's size, and the excess is shared again by weight. That is least(cap, weight * level)
    with one water level; over sources by cap / weight the level is the largest of the candidates below.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    sums = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    s = sums.withColumn("rank", F.row_number().over(every) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_repeat))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return s.select("source", "docs", "source_size", "weight", "rank", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def curriculum(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, shapes=SHAPES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, positions, taken``.

    ``positions`` holds one training time in [0, 1) for each time that the mix takes the document. Within a source,
    documents follow each other in the order of a seeded hash (of id, source and text, so that null and repeated ids spread too), in up to ``ceil(max_repeat)`` passes, and a copy
    that begins at word x of that stream is taken while its middle lies before the target. Its time t is where the
    source's cumulative demand, target * integral of its weight schedule up to t, reaches x. So the mix draws on each source as
    its schedule says at any time, and its total is within half a document of the target.

    Running sums need no source in one task: sums by hash bucket (about ``bucket_rows`` rows each) are run up first,
    then rows within a bucket. Reruns agree: the order depends on (hash, id, size) alone. Null texts have size 0;
    documents of size 0 take no words, and have positions where the stream passes them. A null source is a source.
    Rows that repeat an id are mixed as separate documents. An empty table gives no rows; other columns are ignored.
    """
    return _planned(docs, weights, max_repeat, shapes, seed, id_col, text_col, source_col, bucket_rows).drop("sha")


def _planned(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, shapes=SHAPES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 4096, key: Column | None = None) -> DataFrame:
    """What ``curriculum`` returns, and ``sha``: the ``key`` that tells apart rows of one id."""
    sha = F.lit(None).cast("binary") if key is None else key
    rows = table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"), sha.alias("sha")), "mix-rows")
    targets = table(source_targets(rows, weights, max_repeat), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    rows, t = rows.alias("r"), (F.broadcast(targets) if few else targets).alias("t")
    rows = rows.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "docs", "source_size", "target", "rank")
    n = F.ceil(F.col("docs") / bucket_rows)
    rows = rows.withColumn("bucket", F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * n), n - 1))
    starts = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("sum"))
    starts = starts.select("rank", "bucket", F.coalesce(F.sum("sum").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", "sha").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["rank", "bucket"])
    rows = rows.withColumn("at", F.col("at") + F.col("start"))
    begins = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(0, int(-(-max_repeat // 1)) - 1))), lambda j: j * F.col("source_size") + F.col("at")), lambda x: x + F.col("size") / 2 < F.col("target"))
    segments = F.element_at(_table_of(shapes), (F.col("rank") % len(shapes) + 1).cast("int"))

    def time_of(x: Column) -> Column:
        """Solve before + w0 * d + slope * d * d / 2 = x / target in the segment that holds it."""
        y = x / F.col("target")
        s = F.element_at(F.filter(F.col("segments"), lambda g: g["before"] <= y), -1)
        rest = y - s["before"]
        d = 2 * rest / (s["w0"] + F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * s["slope"] * rest)))
        return F.coalesce(s["t0"] + F.when(rest > 0, d).otherwise(0.0), F.lit(0.0))

    rows = rows.withColumn("segments", segments).withColumn("positions", F.transform(begins, time_of))
    return rows.select("doc_id", "source", "size", "source_size", "target", "positions", (F.size("positions") * F.col("size")).alias("taken"), "sha")


def mix(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, repeated as the curriculum takes them, range-sorted by training time.

    Rows are told apart by id, source and text, so each has its own positions, whether ids are null or repeat. Rows that repeat all three
    hold their positions together, as one of them.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    rows = docs.withColumn("__mix_sha", text_sha(F.col(text_col)))
    plan = _planned(docs, **options, key=text_sha(F.col(text_col))).groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("sha").alias("__mix_key"))
    plan = table(plan.agg(F.count("*").alias("__mix_rows"), F.flatten(F.collect_list("positions")).alias("__mix_at")).filter(F.size("__mix_at") > 0), "mix-plan")
    if plan.filter("__mix_rows > 1").limit(1).take(1):
        rows = rows.dropDuplicates([id_col, source_col, "__mix_sha"])
    same = rows[id_col].eqNullSafe(plan["__mix_id"]) & rows[source_col].eqNullSafe(plan["__mix_source"]) & (rows["__mix_sha"] == plan["__mix_key"])
    rows = rows.join(plan, same).drop("__mix_id", "__mix_source", "__mix_key", "__mix_sha", "__mix_rows").withColumn("__mix_at", F.explode("__mix_at"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "__mix_at", id_col).sortWithinPartitions("__mix_at", id_col).drop("__mix_at")
