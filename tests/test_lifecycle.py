"""Pairing when one hash is on half of all files, and keyed state against joins of snapshots."""

import random

from pyspark.sql import functions as F

from tessera.operators import lifecycle


def test_a_hot_hash_is_numbered_in_blocks(spark):
    """Blocks of 40 rows: the same numbers as of one window, and no task holds the hash."""
    rng = random.Random(1)
    rows = [("s", f"p{rng.randrange(10**6):06d}", "hot" if rng.random() < 0.5 else f"h{rng.randrange(30)}", rng.choice([None, *range(300)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "section string, rel_path string, content_hash string, walk_order int").repartition(4)
    want = {}
    for section, path, h, _ in sorted(rows, key=lambda r: r[1]):
        want.setdefault((section, h), []).append(path)
    got = lifecycle.ranked(df, "rel_path", block=40)
    assert sorted((r["content_hash"], r["__n"], r["rel_path"]) for r in got.collect()) == sorted((h, n, p) for (_, h), ps in want.items() for n, p in enumerate(ps))
    numbers = lifecycle.ranked(df, "walk_order", block=40).groupBy("content_hash").agg(F.sort_array(F.collect_list("__n")).alias("n")).collect()
    assert all(r["n"] == list(range(len(r["n"]))) for r in numbers)
    assert "__block" not in got.columns and lifecycle.ranked(df.limit(0), "rel_path").count() == 0


def test_dispatch_and_diff_with_a_hot_hash(spark):
    """All empty files share a hash: moves pair them in order, whatever the blocks."""
    disk = spark.createDataFrame([("s", f"new/{i:04d}", "empty" if i % 2 else f"h{i}", 1) for i in range(300)], "section string, rel_path string, content_hash string, size long").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    state = spark.createDataFrame([("s", f"old/{i:04d}", "empty" if i % 2 else f"h{i}", 1, "ingested", True, 1, 1) for i in range(280)], "section string, rel_path string, content_hash string, size long, status string, in_use boolean, total_chunks int, chunks_done int").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    one = sorted(map(tuple, lifecycle.dispatch(disk, state).collect()), key=repr)
    assert sorted(map(tuple, lifecycle.dispatch(disk, state, block=25).collect()), key=repr) == one and sum(r[3] == "moved" for r in one) == 280
    assert sorted(map(tuple, lifecycle.daemon_diff(disk, state, block=25).collect()), key=repr) == sorted(map(tuple, lifecycle.daemon_diff(disk, state).collect()), key=repr)
