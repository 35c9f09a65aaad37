"""Posting lists and the vector index against whole scans, and what they read."""

import random

import numpy as np
import pytest

from tessera.operators import postings, search, sparse
from tessera.operators.postings import PostingIndex
from tessera.operators.vector_index import VectorIndex, recall


def corpus(spark, n, parts=3):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(1, 30)))
        if i % 50 == 0:
            text += " RARE" * rng.randrange(1, 4)
        rows.append((f"f{i:05d}", i % 3, None if i == 5 else "" if i == 6 else text))
    return spark.createDataFrame(rows, "source_file string, chunk int, text string").repartition(parts).cache()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('index')}"


def test_posting_lists_equal_a_whole_scan(spark, folder):
    points = corpus(spark, 900)
    index = PostingIndex.build(points, folder, ["source_file", "chunk"], buckets=5, range_size=16)
    index = PostingIndex.open(spark, index.path)
    for text, k in (("w1 w7 rare w7", 10), ("rare", 50), ("w0", 3), ("w59 w58 w57 nowhere", 5), ("nowhere", 4), ("", 2), ("w0 w1 w2 w3 w4", 2000)):
        query = {r["term"]: r["qtf"] for r in search.query_terms(spark, text).collect()}
        want = search.top(search.keyword_scores(points, query, ["source_file", "chunk"]), k, ["source_file", "chunk"]).collect()
        assert [tuple(r) for r in index.search(query, k).collect()] == [tuple(r) for r in want], text


def test_many_queries_at_once(spark, folder):
    points = corpus(spark, 500)
    rng = random.Random(3)
    queries = spark.createDataFrame([(q, " ".join(rng.choice(["rare", *(f"w{i}" for i in range(60))]) for _ in range(rng.randrange(1, 6)))) for q in range(40)], "q int, text string")
    asked = sparse.term_frequencies(queries, ["q"]).withColumnRenamed("tf", "qtf")
    index = PostingIndex.build(points, folder, ["source_file"], range_size=8)
    want = search.top_by(search.keyword_batch(points, asked, ["source_file"], ["q"]), 4, ["q"], ["source_file"])
    got = index.search_all(asked, 4, ["q"])
    assert sorted(map(tuple, got.select("q", "source_file", "rank", "score").collect())) == sorted(map(tuple, want.select("q", "source_file", "rank", "score").collect()))


def test_ranges_below_the_threshold_are_not_read(spark, folder, monkeypatch):
    """Points that lie by topic: postings are read of few ranges, and their number doesn't follow the corpus."""
    read = []
    plain = PostingIndex._scores
    monkeypatch.setattr(PostingIndex, "_scores", lambda self, lists, weights, ranges, q, hint: (read.append(ranges.count()), plain(self, lists, weights, ranges, q, hint))[1])
    counts = {}
    for n in (2000, 8000):
        rows = [(f"f{i:06d}", "sea " * (30 if i // 100 == 3 and i % 7 == 0 else 1) + f"x{i % 90}") for i in range(n)]
        index = PostingIndex.build(spark.createDataFrame(rows, "source_file string, text string").coalesce(1), folder, ["source_file"], range_size=50)
        read.clear()
        best = index.search({"sea": 1}, 5).collect()
        assert [r["source_file"] for r in best] == [f"f{i:06d}" for i in range(301, 400) if i % 7 == 0][:5]
        counts[n] = sum(read)
    assert counts[2000] == counts[8000] < 8


def test_a_rare_term_reads_files_of_its_own(spark, folder):
    """Four times the corpus, no more bytes for a term that is as rare as before."""
    size = {}
    for n in (1000, 4000):
        rows = [(f"f{i:06d}", f"w{i % 97} w{i % 89} v{i}" + (" needle" if i in (3, 700) else "")) for i in range(n)]
        index = PostingIndex.build(spark.createDataFrame(rows, "source_file string, text string").repartition(4), folder, ["source_file"], buckets=n // 50)
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        length = lambda f: fs.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)).getLen()  # noqa: B023, E731
        size[n] = sum(length(f) for f in index.postings(["needle"]).inputFiles()), sum(length(f) for f in index.postings().inputFiles())
        assert sorted(r["source_file"] for r in index.search({"needle": 1}, 5).collect()) == ["f000003", "f000700"]
    assert size[4000][0] < 1.5 * size[1000][0] and size[4000][1] > 2 * size[1000][1] and size[4000][0] < size[4000][1] / 20
    assert postings.RANGE == 1024


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) * 0.6
    x[7], x[9] = 0, x[8]
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None)], "id long, v array<float>").repartition(4).cache()


def test_vector_index_finds_nine_in_ten(spark, vectors, folder):
    queries = vectors.filter("id % 50 = 0").selectExpr("id AS q", "v")
    exact = search.nearest(vectors.filter("v IS NOT NULL"), queries, 10, "id", "q", "v")
    index = VectorIndex.open(spark, VectorIndex.build(vectors, folder, "id", "v").path)
    found = index.search(queries, 10, "q", "v").cache()
    r = recall(found, exact, "q", "id").first()
    assert r["queries"] == 60 and r["wanted"] == 600 and r["hits"] >= 0.9 * r["wanted"]
    assert index.rows == 3000 and index.probes < len(index.cells)
    scores = {(a["q"], a["id"]): a["score"] for a in exact.collect()}
    both = [a for a in found.collect() if (a["q"], a["id"]) in scores]
    assert all(a["score"] == scores[a["q"], a["id"]] for a in both)  # scores are exact
    everything = index.search(queries, 10, "q", "v", probes=10**6, candidates=10**4)
    assert sorted(map(tuple, everything.select("q", "id", "rank").collect())) == sorted(map(tuple, exact.select("q", "id", "rank").collect()))


def test_vector_index_of_little(spark, folder):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    index = VectorIndex.build(few, folder, "id", "v", stretches=2)
    assert [(r["q"], r["id"], r["score"]) for r in index.search(few.limit(1).selectExpr("id AS q", "v"), 2, "q", "v").orderBy("rank").collect()] == [(1, 2, 1.0), (1, 3, 0.0)]
    none = VectorIndex.build(few.filter("id > 9"), folder, "id", "v", stretches=2)
    assert none.search(few.selectExpr("id AS q", "v"), 2, "q", "v").count() == 0


def test_exact_search_holds_few_scores(spark, vectors, monkeypatch):
    """Queries and rows are cut, whatever their numbers, and ties stay by id."""
    queries = vectors.filter("id % 10 = 0 AND v IS NOT NULL").selectExpr("id AS q", "v")
    rows = vectors.filter("v IS NOT NULL")
    x = {r["id"]: np.array(r["v"], np.float64) for r in rows.collect()}
    norm = {i: np.sqrt(v @ v) for i, v in x.items()}
    got = {}
    for r in search.nearest(rows, queries, 3, "id", "q", "v").collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for q in list(got)[:40]:
        score = {i: round(float(x[q] @ v / (norm[q] * norm[i])) if norm[q] * norm[i] else 0.0, 9) for i, v in x.items() if i != q}
        assert [i for _, i in sorted(got[q])] == sorted(score, key=lambda i: (-score[i], i))[:3]
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 4, (50, 30)).astype(float), np.arange(30) * 7
    a, b = search.keep_best(np.full((50, 5), -np.inf), np.full((50, 5), 10**6), score[:, :11], ids[:11])
    a, b = search.keep_best(a, b, score[:, 11:], ids[11:])
    for i in range(50):
        best = sorted(range(30), key=lambda j: (-score[i, j], j))[:5]  # noqa: B023
        assert list(b[i]) == [7 * j for j in best] and list(a[i]) == [score[i, j] for j in best]
