"""Writers side by side, dead writers, fail-soft ingestion."""

import threading
import time
from datetime import timedelta

import pytest

from pyspark.sql import functions as F

from tessera.operators import gates, search
from tessera.plans.engine import Engine
from tessera.plans.store import POINT, Store
from tessera.sources.config import Config
from tessera.sources.embedding import EmbedError, HashEmbedder


def point(spark, section, *names):
    return spark.createDataFrame([(f"{section}/{n}", section, n, "h", n, 0, 0, [1.0], [1], [1.0]) for n in names], POINT)


def test_writers_keep_each_others_points(spark, tmp_path):
    """Two writers of one section, and one of another, all of which have read before any writes."""
    store = Store(spark, f"file://{tmp_path}/store")
    store.upsert_points(point(spark, "a", "old"))
    together, errors = threading.Barrier(3), []

    def write(section, name):
        def change(old):
            if not seen:
                seen.append(1)
                try:
                    together.wait(2)
                except threading.BrokenBarrierError:
                    pass
            return old.unionByName(point(spark, section, name))

        seen = []
        try:
            store.update_points(section, change)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=x) for x in (("a", "one"), ("a", "two"), ("b", "three"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors and sorted(r["id"] for r in store.points().collect()) == ["a/old", "a/one", "a/two", "b/three"]
    before = {f for f in (tmp_path / "store/points/s-b").rglob("*.parquet")}
    store.upsert_points(point(spark, "a", "four"))
    assert {f for f in (tmp_path / "store/points/s-b").rglob("*.parquet")} == before  # a write to one section touches no other


def test_dead_writers(spark, tmp_path):
    """A claim and a lock whose holder died are passed over after their lease, and not before."""
    store = Store(spark, f"file://{tmp_path}/store", lease=timedelta(seconds=2))
    store.upsert_points(point(spark, "a", "old"))
    assert store._create("points/s-a/claims/c-000000000001", "dead")
    began = time.time()
    store.upsert_points(point(spark, "a", "new"))
    assert time.time() - began > 1 and store.points("a").count() == 2
    assert store._create("locks/a", "dead")
    with store.lock("a") as mine:
        assert not mine
    time.sleep(2.5)
    with store.lock("a") as mine:
        assert mine
        time.sleep(3)  # the holder renews its lock
        with store.lock("a") as other:
            assert not other
    assert not store.exists("locks/a")


class Moody(HashEmbedder):
    """Fails on texts with a word."""

    word = ""

    def embed(self, model, texts):
        if any(self.word and self.word in t for t in texts):
            raise EmbedError("no")
        return super().embed(model, texts)


@pytest.fixture
def docs(tmp_path):
    folder = tmp_path / "wiki/docs"
    folder.mkdir(parents=True)
    (folder / "section.yaml").write_text("chunk_size: 50\n")
    for name in ("apple", "pear", "plum"):
        (folder / f"{name}.md").write_text(f"# {name}\n\nAll about the {name}.\n")
    return folder


def test_an_embedder_fails_for_a_file(spark, docs, tmp_path):
    embedder = Moody(8)
    object.__setattr__(embedder, "word", "pear")
    engine = Engine(spark, Config(wiki_dir=str(docs.parent)), Store(spark, f"file://{tmp_path}/store"), embedder, batch_files=2)
    summary = engine.ingest_section("docs")
    # batches of one text, so that a call fails for one file only
    rows = {r["rel_path"]: (r["status"], r["error_reason"]) for r in engine.store.files("docs").collect()}
    assert rows["pear.md"] == ("error", "no") and summary.errored >= 1 and "pear.md" not in {r["source_file"] for r in engine.store.points().collect()}
    object.__setattr__(embedder, "word", "")
    engine.ingest_section("docs")
    assert {r["status"] for r in engine.store.files("docs").collect()} == {"ingested"} and engine.store.points().count() == 3
    assert engine.store._names("work") == []  # work tables are gone


def test_unreadable_files_have_rows(spark, docs, tmp_path):
    (docs / "gone.md").symlink_to(docs / "nowhere.md")
    engine = Engine(spark, Config(wiki_dir=str(docs.parent)), Store(spark, f"file://{tmp_path}/store"), HashEmbedder(8))
    summary = engine.ingest_section("docs")
    row = engine.store.row("docs", "gone.md")
    assert (row["status"], row["in_use"], summary.errored, summary.new) == ("error", False, 1, 3) and row["error_reason"].startswith("unreadable")
    n = engine.store.events("docs").count()
    engine.ingest_section("docs")
    assert engine.store.events("docs").count() == n  # nothing new to say


def test_keyword_search_does_not_shuffle_terms(spark):
    points = spark.createDataFrame([(f"f{i}", f"sea stone w{i % 7} sea") for i in range(50)], "source_file string, text string").repartition(4)
    scores = search.keyword_scores(points, {"sea": 1, "w3": 2, "none": 1}, ["source_file"])
    assert scores.count() == 50
    plan = search.top(scores, 3, ["source_file"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    assert [r["source_file"] for r in search.top(scores, 3, ["source_file"]).collect()] == ["f10", "f17", "f24"]
    live = spark.createDataFrame([("a", [5, 9], [2.0, 1.0]), ("b", [9], [1.0]), ("c", [4], [1.0])], "id string, indices array<long>, values array<double>")
    got = {r["id"]: r["score"] for r in search.array_scores(live, live, {5: 1, 9: 2}, ["id"]).collect()}
    idf = lambda df: __import__("math").log(1 + (3 - df + 0.5) / (df + 0.5))
    assert got == pytest.approx({"a": 2 * idf(1) + 2 * idf(2), "b": 2 * idf(2)})
    assert search.keyword_scores(points, {}, ["source_file"]).count() == search.array_scores(live, live, {}, ["id"]).count() == 0


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, dense array<double>").repartition(3)
    q = e.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "dense")
    whole = sorted(search.nearest(e, q, 3, "vec_id", "query_id").collect())
    assert sorted(search.nearest(e, q, 3, "vec_id", "query_id", block_bytes=50).collect()) == whole and len(whole) == 30
    assert all(r["vec_id"] != r["query_id"] for r in whole)


def test_verdicts_gather_a_sample(spark):
    files = spark.createDataFrame([("s", f"p{i:03}", "pending") for i in range(40)] + [("s", "c", "changed"), ("t", "x", "ok")], "section string, rel_path string, category string")
    rows = {r["section"]: r for r in gates.verdicts(files, sample=2).collect()}
    assert rows["s"]["pending"] == ["p000", "p001", "...(+38 more)"] and rows["s"]["changed"] == ["c"] and rows["s"]["summary"] == "40 pending, 1 changed"
    assert rows["t"]["complete"] and rows["t"]["pending"] == []
