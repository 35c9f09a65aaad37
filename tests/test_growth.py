"""What grows with the input, and what must not: each test would fail on the code before it."""

import re
import time

from pyspark.sql import functions as F

from tessera.operators import chunking, search, sparse
from tessera.plans.engine import Engine
from tessera.plans.store import Store
from tessera.sources import discovery
from tessera.sources.config import Config
from tessera.sources.embedding import HashEmbedder

TEXTS = [(1, "b a b É é ß x_1"), (2, None), (None, "q q"), (None, "q r"), (3, ""), (4, " .. "), (5, "a, A; b")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_row(spark):
    """Texts of different keys shuffle nothing and fill no hash table; equal keys, null ones too, are one text."""
    texts = spark.createDataFrame([t for t in TEXTS if t[0]], "id int, text string")
    assert not re.search("Exchange|Aggregate", plan(sparse.term_frequencies(texts, ["id"])))
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    rows = {tuple(r) for r in sparse.term_frequencies(texts, ["id"]).collect()}
    assert rows == {(1, "a", 1), (1, "b", 2), (1, "é", 2), (1, "ß", 1), (1, "x_1", 1), (None, "q", 3), (None, "r", 1), (5, "a", 2), (5, "b", 1)}


def test_vectors_are_made_in_their_row(spark):
    texts = spark.createDataFrame([t for t in TEXTS if t[0]], "id int, text string")
    assert not re.search("Exchange|Aggregate", plan(sparse.text_vectors(texts, ["id"])))
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    want = sparse.sparse_vectors(sparse.term_frequencies(texts, ["id"]), ["id"])
    assert sorted(map(str, sparse.text_vectors(texts, ["id"]).collect())) == sorted(map(str, want.collect()))
    assert {r["id"] for r in sparse.with_vectors(texts).filter("values IS NULL").collect()} == {2, 3, 4}


def test_batches_of_queries_count_terms_in_rows(spark):
    points = spark.createDataFrame([("a", "x y x"), ("b", "y")], "source_file string, text string")
    queries = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "q int, term string, qtf long")
    scores = search.keyword_batch(points, queries, ["source_file"], ["q"])
    assert "term" not in " ".join(re.findall(r"HashAggregate\(keys=\[source_file[^\]]*\]", plan(scores)))
    assert {r["source_file"] for r in scores.collect()} == {"a", "b"}


def test_words_are_fitted_in_one_pass():
    """A run of words isn't counted again for each of them; cuts are those of any other counter."""
    text = "a bb " * 700 + "w" * 900 + " ccc" * 70
    plain = lambda t: chunking.estimate_tokens(t)
    for size in (1, 7, 60, 512):
        assert list(chunking.fit_words(text, size, chunking.estimate_tokens)) == list(chunking.fit_words(text, size, plain))
    start = time.process_time()
    assert len(list(chunking.fit_words("a " * 30_000, 100_000, chunking.estimate_tokens))) == 1
    assert time.process_time() - start < 2  # counted anew for each word: 15 s and more


def test_opening_files_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """One task lists a directory, however many files it has; they are opened in several, and listed rows are held in slices."""
    monkeypatch.setattr(discovery, "FILES_A_TASK", 10)
    for i in range(35):
        (tmp_path / f"f{i}.txt").write_text("x")
    found = discovery.discover_files(spark, tmp_path)
    assert found.select(F.spark_partition_id()).distinct().count() == 4 and found.count() == 35


def test_batches_read_neither_points_nor_state(spark, tmp_path, monkeypatch):
    """Batches of new files read what they wrote only, so that many of them cost as many times one."""
    folder = tmp_path / "wiki" / "docs"
    folder.mkdir(parents=True)
    (folder / "section.yaml").write_text("description: d\n")
    for i in range(40):
        (folder / f"f{i}.txt").write_text(f"text number {i}")
    engine = Engine(spark, Config(wiki_dir=str(tmp_path / "wiki")), Store(spark, f"file://{tmp_path}/store"), HashEmbedder(4), batch_files=10)
    reads = []
    points, files = Store.points, Store.files
    monkeypatch.setattr(Store, "points", lambda self, section=None: (reads.append("points"), points(self, section))[1])
    monkeypatch.setattr(Store, "files", lambda self, section=None: (reads.append("files"), files(self, section))[1])
    assert engine.ingest_section("docs").new == 40
    assert reads == ["files"]
    assert engine.store.files("docs").filter("status = 'ingested' AND chunks_done = total_chunks AND in_use").count() == 40
    assert engine.live_points("docs").count() == 40
