"""Incremental maintenance as joins of two snapshots: what is on disk, and what the state says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.identity import point_id

KEY = ["section", "rel_path"]
#: Seconds by which two modification times may differ (fixed value).
MTIME_TOLERANCE = 1e-3


def latest(events: DataFrame) -> DataFrame:
    """Current state from appended events: the last event of each file, unless it deletes the file."""
    cols = [c for c in events.columns if c not in ("seq", "deleted")]
    # One max per key combines before the shuffle, which a window's row_number can't.
    last = events.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in events.columns if c not in KEY]), "seq").alias("e"))
    return last.filter("NOT e.deleted").select(*[F.col(c) if c in KEY else F.col(f"e.{c}") for c in cols])


#: Rows of a side in one block of ranks, or so; and the most blocks, whose ends are literals: beyond, a hot hash is numbered in that many tasks.
PAIR_BLOCK, MOST_BLOCKS = 100_000, 256


def ranked(rows: DataFrame, order: str, name: str = "__n", block: int = PAIR_BLOCK) -> DataFrame:
    """Number rows from 0 within (section, content_hash), in their order; a hash that many rows share is numbered in several tasks.

    Rows go to blocks by ranges of their order, which are the same for all hashes. A row's number is its number within hash and block, plus how many rows of its hash the blocks before hold: a
    prefix sum over a row for each hash and block, not over rows. Ends of blocks come from a sample of 50 values a block; rows of equal order are never parted.
    """
    n = rows.count()
    ends = []
    if n > block:
        blocks = min(MOST_BLOCKS, -(-n // block))
        sample = rows.select(F.col(order).alias("o")).sample(min(1.0, 50 * blocks / n), seed=1).orderBy("o").collect()
        values = [r["o"] for r in sample if r["o"] is not None]
        ends = sorted({values[i * len(values) // blocks] for i in range(1, blocks)}) if values else []
    at = F.lit(0)
    if ends:
        at = F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col(order))), F.lit(0))
    key = ["section", "content_hash"]
    rows = rows.withColumn("__block", at)
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(*key, "__block").orderBy(order)) - 1)
    if not ends:
        return inside.drop("__block")
    counts = rows.groupBy(*key, "__block").agg(F.count("*").alias("__rows"))
    counts = counts.select(F.col("section").alias("__s"), F.col("content_hash").alias("__h"), F.col("__block").alias("__b"), "__rows")
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("__s", "__h").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__s", "__h", "__b", before.alias("__before"))
    same = F.col("section").eqNullSafe(F.col("__s")) & F.col("content_hash").eqNullSafe(F.col("__h")) & F.col("__block").eqNullSafe(F.col("__b"))
    return inside.join(counts, same).withColumn(name, F.col(name) + F.col("__before")).drop("__block", "__before", "__s", "__h", "__b")


def _paired(left: DataFrame, right: DataFrame, left_order: str, right_order: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Rows of both sides one to one by (section, content_hash), each side in its order. The join is by hash and number, so a hot hash is spread by its numbers."""
    return ranked(left, left_order, block=block).join(ranked(right, right_order, block=block), ["section", "content_hash", "__n"]).drop("__n")


def dispatch(disk: DataFrame, state: DataFrame, walk_order: str = "rel_path", block: int = PAIR_BLOCK) -> DataFrame:
    """(section, rel_path, content_hash, action, moved_from, resume_from) for each file on disk (with its hash).

    Without a row: moved, if an ingested row with the same hash has a path that is not on disk (paired one to one), else new. With a row: ingested
    with the same hash is unchanged, or restored where out of use; ingesting with the same hash is resumed; all else is changed.
    """
    s = state.select(*KEY, F.col("content_hash").alias("old_hash"), "status", "in_use", "total_chunks", "chunks_done")
    both = disk.join(s, KEY, "left_outer")
    fresh = both.filter("status IS NULL").select("section", F.col("rel_path").alias("new_path"), "content_hash", *([walk_order] if walk_order not in ("rel_path", "section", "content_hash") else []))
    gone = state.filter("status = 'ingested'").join(disk.select(*KEY), KEY, "left_anti").select("section", F.col("rel_path").alias("moved_from"), "content_hash")
    moves = _paired(fresh, gone, "new_path" if walk_order == "rel_path" else walk_order, "moved_from", block).select("section", F.col("new_path").alias("rel_path"), "moved_from")
    same = F.col("content_hash") == F.col("old_hash")
    action = (
        F.when(F.col("status").isNull(), F.when(F.col("moved_from").isNotNull(), "moved").otherwise("new"))
        .when((F.col("status") == "ingested") & same & F.col("in_use"), "unchanged")
        .when((F.col("status") == "ingested") & same, "restored")
        .when((F.col("status") == "ingesting") & same, "resumed")
        .otherwise("changed")
    )
    out = both.join(moves, KEY, "left_outer").withColumn("action", action)
    resume = F.when(F.col("action") == "resumed", F.least("chunks_done", "total_chunks")).otherwise(0)
    return out.select(*KEY, "content_hash", "action", "moved_from", resume.alias("resume_from"))


def looks_changed(size: Column, mtime: Column, old_size: Column, old_mtime: Column) -> Column:
    """The cheap test before hashing: another size, no stored time, or a time further off than the tolerance."""
    apart = F.abs(F.unix_micros(mtime) - F.unix_micros(old_mtime)) / 1e6
    return (size != old_size) | old_mtime.isNull() | F.coalesce(apart > MTIME_TOLERANCE, F.lit(True))


def daemon_diff(disk: DataFrame, state: DataFrame, walk_order: str = "rel_path", block: int = PAIR_BLOCK) -> DataFrame:
    """(section, rel_path, action, new_path) for rows in use whose file changed, moved or went; ``disk`` has content_hash, size and mtime.

    changed hides a row; move gives it the path of a new file with the same hash (one to one); delete marks it for deletion. New files alone do nothing.
    """
    live = state.filter("status = 'ingested' AND in_use")
    old = live.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    touched = disk.join(old, KEY).filter(looks_changed(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("old_mtime")) & (F.col("content_hash") != F.col("old_hash")))
    changed = touched.select(*KEY, F.lit("changed").alias("action"), F.lit(None).cast("string").alias("new_path"))
    gone = live.join(disk.select(*KEY), KEY, "left_anti").select(*KEY, "content_hash")
    appeared = disk.join(state.select(*KEY), KEY, "left_anti").select("section", F.col("rel_path").alias("new_path"), "content_hash", *([walk_order] if walk_order != "rel_path" else []))
    moves = _paired(appeared, gone, "new_path" if walk_order == "rel_path" else walk_order, "rel_path", block).select(*KEY, "new_path")
    lost = gone.select(*KEY).join(moves, KEY, "left_outer").select(*KEY, F.when(F.col("new_path").isNull(), "delete").otherwise("move").alias("action"), "new_path")
    return changed.unionByName(lost)


def expired(state: DataFrame, now: Column) -> DataFrame:
    """Rows whose grace is over, by section and path."""
    return state.filter(~F.col("in_use") & F.col("delete_after").isNotNull() & (F.col("delete_after") <= now)).orderBy(*KEY)


def purge(points: DataFrame, state: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Points and state without expired files."""
    dead = expired(state, now).select("section", F.col("rel_path").alias("source_file"))
    return points.join(dead, ["section", "source_file"], "left_anti"), state.join(dead.withColumnRenamed("source_file", "rel_path"), KEY, "left_anti")


def orphans(state_sections: DataFrame, discovered: DataFrame) -> DataFrame:
    """Sections that the state knows and the disk doesn't."""
    return state_sections.select("section").distinct().join(discovered.select("section"), "section", "left_anti")


def repath(points: DataFrame, moves: DataFrame) -> DataFrame:
    """Points with new paths and ids where their file moved (section, source_file, new_path, content_hash); vectors stay as they are."""
    m = points.join(moves.select("section", "source_file", "new_path", F.col("content_hash").alias("__hash")), ["section", "source_file"], "left_outer")
    m = m.withColumn("source_file", F.coalesce("new_path", "source_file"))
    moved = point_id(F.col("section"), F.col("source_file"), F.col("__hash"), F.col("chunk_index"))
    return m.withColumn("id", F.when(F.col("new_path").isNotNull(), moved).otherwise(F.col("id"))).select(*points.columns)


def in_use(points: DataFrame, state: DataFrame) -> DataFrame:
    """Points of the current version of files in use: derived from the state by a join, so nothing has to be flagged."""
    live = state.filter("in_use AND status IN ('ingested', 'ingesting', 'error')").select("section", F.col("rel_path").alias("source_file"), "content_hash")
    return points.join(live, ["section", "source_file", "content_hash"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)
