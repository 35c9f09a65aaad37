"""What a batch of an ingest costs: each would fail on the code before it."""

import re

from pyspark.sql import functions as F

from tessera.operators import sparse
from tessera.operators.postings import POSTINGS, PostingIndex, _lists
from tessera.plans import engine as engines
from tessera.plans.engine import Engine
from tessera.plans.store import Store
from tessera.sources import discovery
from tessera.sources.config import Config
from tessera.sources.embedding import HashEmbedder


def test_batches_are_few_and_written_once(spark, tmp_path, monkeypatch):
    """A run has a bounded number of batches, and a batch's points are written once, as what a version then names."""
    folder = tmp_path / "wiki" / "docs"
    folder.mkdir(parents=True)
    (folder / "section.yaml").write_text("description: d\n")
    for i in range(12):
        (folder / f"f{i}.txt").write_text(f"text number {i}" if i else "")
    monkeypatch.setattr(engines, "MOST_BATCHES", 2, raising=False)
    engine = Engine(spark, Config(wiki_dir=str(tmp_path / "wiki")), Store(spark, f"file://{tmp_path}/store"), HashEmbedder(4), batch_files=2)
    commits, commit = [], Store.commit_points
    monkeypatch.setattr(Store, "commit_points", lambda self, section, make, whole=False: (commits.append(make(None)[0]), commit(self, section, make, whole))[1])
    assert engine.ingest_section("docs").new == 12
    assert len(commits) == 2 and all(isinstance(c, str) and engine.store.exists(c) for c in commits)
    assert engine.store.points("docs").count() == 11 and engine.store.files("docs").filter("status = 'ingested' AND chunks_done = total_chunks").count() == 12
    assert engine.store.term_counts("docs", [])[0] == 11


def test_a_filter_of_files_reads_them_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_bytes(b"a\0b")
    found = discovery.discover_files(spark, tmp_path).filter("skip_reason IS NULL").select("rel_path")
    plan = found._jdf.queryExecution().executedPlan().toString()  # before it runs
    assert plan.count("ArrowEvalPython") == 1 and not re.search("Filter .*regexp_extract", plan)
    assert [r[0] for r in found.collect()] == ["a.txt"]


def test_vectors_count_terms_as_numbers(spark):
    """Terms of a row are neither sorted nor counted in expressions; results are those of the expressions."""
    texts = spark.createDataFrame([(1, "b a b É é ß x_1"), (2, None), (3, ""), (4, " .. "), (5, "a, A; b \U0001d7d8 ￜ")], "id int, text string").coalesce(1)
    made = sparse.with_vectors(texts)
    assert "lambdafunction" not in made._jdf.queryExecution().executedPlan().toString()
    want = {r["id"]: (r["indices"], r["values"]) for r in sparse.sparse_vectors(sparse.term_frequencies(texts, ["id"]), ["id"]).collect()}
    assert {r["id"]: (r["indices"], r["values"]) for r in made.collect()} == want | {k: (None, None) for k in (2, 3, 4)}
    assert made.filter(F.col("indices").isNull()).count() == 3


def test_lists_are_made_where_points_are_read(spark, tmp_path):
    """Posting rows shuffle once, when they are dealt to files; a range that is cut in two has two rows for a term, which are added up."""
    rows = [(5, 0, [("b", 2), ("a", 1)]), (5, 1, None), (5, 2, [("b", 7)]), (6, 0, [("a", 3)]), (6, 1, [])]
    table = spark.createDataFrame(rows, "range long, slot int, t array<struct<term:string,tf:bigint>>").coalesce(1)
    made = table.mapInArrow(_lists, POSTINGS)
    assert sorted(map(tuple, made.collect())) == [("a", 5, 1, 1, [0], [1]), ("a", 6, 1, 3, [0], [3]), ("b", 5, 2, 7, [0, 2], [2, 7])]
    points = spark.createDataFrame([(f"p{i}", f"sea w{i % 3} " + "sea " * (i % 5)) for i in range(40)], "source_file string, text string").coalesce(1)
    index = PostingIndex.build(points, f"file://{tmp_path}", ["source_file"], range_size=8)
    lists = index.postings()
    assert lists.agg(F.sum("n")).first()[0] == 80 and lists.groupBy("term", "range").count().filter("count > 1").count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # ranges go on over batches
    try:
        again = table.union(table.limit(0)).mapInArrow(_lists, POSTINGS)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
