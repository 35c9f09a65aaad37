"""The suffix order of substring dedup: names of pieces are sorted as numbers that hold several ranks, runs are found over a whole shard at once, and shuffle files go with each table."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import suffixes
from tessera.llm.common import table_alone
from tessera.llm.substring_dedup import repeated_runs, repeated_starts


def test_names_are_sorted_in_few_passes(monkeypatch):
    """Names of pieces are put in order without an argsort of them all for each doubling; ties by position, whether or not ranks and position fit one number."""
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **k: (sorted_.append(len(a)) if a.dtype == np.int64 else None, argsort(a, **k))[1])
    rng = np.random.default_rng(4)
    passage = rng.integers(1, 257, 20_000)
    s = np.concatenate([passage, [0], passage[5000:], [0]]).astype(np.int16)
    order = suffixes.suffix_order(s, 400)
    assert sorted(order.tolist()) == list(range(len(s))) and sum(sorted_) == 0, sorted_
    for names, depth in ((np.array([0]), 9), (np.zeros(50, np.int64), 400), (rng.integers(0, 3, 3000), 60), (rng.integers(0, 2, 40), 5)):
        _, names = np.unique(names, return_inverse=True)
        want = sorted(range(len(names)), key=lambda i, t=names.tolist(): t[i : i + depth])
        got = suffixes._by_names(names, 2 * depth)
        assert [names[i : i + depth].tolist() for i in got] == [names[i : i + depth].tolist() for i in want]
    names = rng.integers(0, 1 << 22, (1 << 22) + 5)
    names[:2], names[-3:] = (0, (1 << 22) - 1), names[:3]
    order = suffixes._by_names(names, 1)  # 23 bits for each of two ranks and for the position
    assert (order == np.lexsort((np.append(names[1:], -1), names))).all()


def test_runs_of_a_shard_are_those_of_its_parts():
    rng = random.Random(8)
    made = lambda n: bytes(rng.choices(b"ab\x00\xff", k=n))
    for _ in range(200):
        passage = made(12)
        parts = [made(rng.randrange(20)) + rng.choice([passage, b"", passage[1:]]) + made(rng.randrange(20)) for _ in range(rng.randrange(1, 8))]
        copies = [rng.choice([1, 1, 2]) for _ in parts]
        want = []
        for i, again in enumerate(repeated_starts(parts, copies, 6)):
            text = "".join("x" if a else " " for a in again)
            assert len(again) == max(0, len(parts[i]) - 5)
            runs = [j for j in range(len(text)) if text[j] == "x" and text[j - 1 : j] != "x"]
            want += [(i, j, j + len(text[j:]) - len(text[j:].lstrip("x")) - 1) for j in runs if copies[i] < 2]
        assert list(zip(*(x.tolist() for x in repeated_runs(parts, copies, 6)))) == want


def test_shuffle_files_go_once_a_table_is_written(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    on_disk = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before, was = on_disk(), spark.conf.get(key)
    out = table_alone(spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count(), "alone")
    assert on_disk() <= before and spark.conf.get(key) == was
    assert out.count() == 70 and out.agg(F.sum("count")).first()[0] == 5000
