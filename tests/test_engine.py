from datetime import datetime, timedelta

import pytest

from tessera.plans.engine import Engine
from tessera.plans.health import HealthRegistry
from tessera.plans.store import Store
from tessera.sources.config import Config, Defaults, SectionSettings, load_config, load_section
from tessera.sources.embedding import EmbedError, HashEmbedder, HttpEmbedder


class Flaky(HashEmbedder):
    broken = False

    def embed(self, model, texts):
        if Flaky.broken:
            raise EmbedError("down")
        return super().embed(model, texts)


@pytest.fixture
def wiki(tmp_path):
    docs = tmp_path / "wiki/docs"
    docs.mkdir(parents=True)
    (docs / "section.yaml").write_text("description: the docs\nchunk_size: 50\n")
    (docs / "cuda.md").write_text("# Memory\n\nUse cudaMalloc to allocate device memory.\n")
    (docs / "kin.md").write_text("# Family\n\nA grandmother is the mother of a parent.\n")
    (docs / "data.bin").write_bytes(b"a\0b")
    (docs / ".tesseraignore").write_text("*.log\n")
    (docs / "x.log").write_text("ignored")
    return docs


@pytest.fixture
def engine(spark, wiki, tmp_path):
    now = [datetime(2024, 1, 1)]
    store = Store(spark, f"file://{tmp_path}/store", clock=lambda: now[0])
    e = Engine(spark, Config(wiki_dir=str(wiki.parent)), store, Flaky(16))
    e.now = now
    return e


def found(answer):
    return [r["source_file"] for r in answer["results"]]


def test_lifecycle(engine, wiki):
    assert [s["section"] for s in engine.sections()] == ["docs"]
    assert "not been ingested" in engine.search("docs", "memory")["error"]
    assert engine.ingest() == {"started": ["docs"], "already_running": []}
    summary = engine.runs["docs"]["summary"]
    assert (engine.runs["docs"]["status"], summary["new"], summary["skipped"]) == ("completed", 2, 1), engine.runs
    for mode in ("keyword", "semantic", "hybrid"):
        assert found(engine.search("docs", "cudaMalloc device memory", 2, mode))[0] == "cuda.md"
    assert engine.search("docs", "grandmother", 1, "keyword")["results"][0]["text"].startswith("# Family")
    assert engine.search("docs", "!!!", 1, "keyword")["results"] == []
    assert "none of" in engine.search("docs", "x", mode="magic")["error"]
    with pytest.raises(ValueError):
        engine.search("docs", "x", 0, "keyword")
    assert [f["source_file"] for f in engine.list_files("docs")["files"]] == ["cuda.md", "kin.md"]
    assert engine.get_chunks("docs", "kin.md", 0, 1)["chunks"][0]["chunk_index"] == 0
    assert engine.get_chunks("docs", "kin.md", 0, 0)["chunks"] == []
    assert engine.section_details("docs")["coverage"]["ingested"] == 2
    # nothing has changed
    engine.ingest("docs")
    assert engine.runs["docs"]["summary"]["unchanged"] == 2
    # moved: new ids, the same vectors
    (wiki / "kin.md").rename(wiki / "family.md")
    assert engine.poll() == {"docs": {"move": 1}}
    assert found(engine.search("docs", "grandmother", 1, "keyword")) == ["family.md"]
    # changed: hidden until ingested
    (wiki / "cuda.md").write_text("# Memory\n\nNow about threads and blocks.\n")
    assert engine.poll() == {"docs": {"changed": 1}}
    assert "incomplete" in engine.search("docs", "threads", 1, "keyword")["error"]
    partial = engine.search("docs", "grandmother", 1, "keyword", allow_incomplete=True)
    assert found(partial) == ["family.md"] and "1 changed" in partial["warnings"][0]
    engine.ingest("docs")
    assert engine.runs["docs"]["summary"]["changed"] == 1
    assert found(engine.search("docs", "threads", 1, "keyword")) == ["cuda.md"]
    # deleted: marked, restored, deleted again, purged after the grace
    text = (wiki / "family.md").read_text()
    (wiki / "family.md").unlink()
    assert engine.poll() == {"docs": {"delete": 1}}
    assert engine.purge() == {}
    (wiki / "family.md").write_text(text)
    engine.ingest("docs")
    assert engine.runs["docs"]["summary"]["restored"] == 1
    (wiki / "family.md").unlink()
    engine.poll()
    engine.now[0] += timedelta(days=8)
    with engine.store.lock("docs") as mine:
        assert mine and engine.purge() == {"docs": "skipped (locked)"} and engine.ingest_section("docs").status == "already_running"
    assert engine.purge() == {"docs": ["family.md"]}
    assert engine.store.points().count() == 1
    status = engine.status()
    assert status["sections"]["docs"]["skipped"][0]["rel_path"] == "data.bin" and status["models"][0]["status"] == "healthy"
    # another chunk size: dense search is blocked, keyword search warns; an ingest resets
    (wiki / "section.yaml").write_text("chunk_size: 60\n")
    assert "out of date" in engine.search("docs", "threads")["error"]
    assert "out of date" in engine.search("docs", "threads", 1, "keyword")["warnings"][0]
    engine.ingest("docs")
    assert engine.runs["docs"]["summary"]["reset"]
    # the embedder goes down
    Flaky.broken = True
    try:
        assert "can't be embedded" in engine.search("docs", "threads")["error"]
        assert "unhealthy" in engine.search("docs", "threads")["error"]
        assert engine.search("docs", "threads", 1, "keyword")["results"]
        engine.ingest("docs")
        assert engine.runs["docs"]["status"] == "failed"
    finally:
        Flaky.broken = False
    assert [h.status for h in engine.health.recheck()] == ["healthy"]
    # the section goes
    (wiki / "section.yaml").unlink()
    assert engine.clean_orphans() == ["docs"] and engine.store.points().count() == 0 and engine.store.files().count() == 0


def test_failed_files_keep_the_rest(engine, wiki):
    (wiki / "a.pdf").write_bytes(b"%PDF")
    engine.parser = lambda data: 1 / 0
    engine.ingest("docs")
    assert engine.runs["docs"]["summary"]["errored"] == 1
    assert engine.store.row("docs", "a.pdf")["status"] == "error" and not engine.store.row("docs", "a.pdf")["in_use"]
    engine.parser = lambda data: ["Page one.", " ", "Page three."]
    engine.ingest("docs")
    assert [c["page_number"] for c in engine.get_chunks("docs", "a.pdf")["chunks"]] == [1, 3]


def test_resume_after_a_crash(engine, wiki):
    """Points are written, the commit is not: the next run embeds nothing again."""
    real, engine.store.change = engine.store.change, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash"))
    engine.ingest("docs")
    assert engine.runs["docs"]["status"] == "failed" and engine.store.list_ingesting("docs").count() == 2
    engine.store.change = real
    engine.ingest("docs")
    assert engine.runs["docs"]["summary"]["resumed"] == 2 and engine.store.points().count() == 2
    assert engine.store.list_ingesting("docs").count() == 0


def test_store_states(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: datetime(2024, 1, 1))
    s.begin("a", "f", "h1", 3, None, 4)
    s.set_chunks_done("a", "f", 2)
    assert (s.row("a", "f")["status"], s.row("a", "f")["chunks_done"]) == ("ingesting", 2)
    s.complete("a", "f")
    s.mark_error("a", "f", "bad")
    r = s.row("a", "f")
    assert (r["status"], r["in_use"], r["content_hash"], r["error_reason"]) == ("error", True, "h1", "bad")
    s.complete("a", "f")
    s.tombstone("a", "f", 7)
    assert s.row("a", "f")["delete_after"] == datetime(2024, 1, 8) and s.row("a", "f")["error_reason"] is None
    s.mark_changed("a", "f")
    assert s.row("a", "f")["delete_after"] is None and not s.row("a", "f")["in_use"]
    s.restore("a", "f")
    s.repath("a", "f", "g")
    assert s.row("a", "f") is None and s.row("a", "g")["in_use"] and [x["rel_path"] for x in s.find_by_hash("a", "h1").collect()] == ["g"]
    s.record_skip("a", "k", "skipped_binary", "binary", 5)
    with pytest.raises(ValueError):
        s.record_skip("a", "k", "ingested", "x")
    s.delete("a", "g")
    assert [x["rel_path"] for x in s.files("a").collect()] == ["k"]
    s.ensure_section("a", "m", 512, 51)
    s.mark_ingested("a")
    s.ensure_section("a", "m", 256, 25)
    assert tuple(s.fingerprints().first()) == ("a", "m", 256, 25, datetime(2024, 1, 1))


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("")
    assert load_config(str(tmp_path / "c.yaml")) == Config()
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "missing.yaml"))
    (tmp_path / "c.yaml").write_text(f"models:\n  m: {{max_context: 100, tokenizer_path: {tmp_path}/c.yaml}}\ndefaults: {{embed_model: m, chunk_size: 99}}\n")
    with pytest.raises(ValueError, match="does not fit"):
        load_config(str(tmp_path / "c.yaml"))
    for bad in ({"chunk_size": 31}, {"chunk_overlap_ratio": 1.0}, {"headroom_ratio": 0.6}):
        with pytest.raises(ValueError):
            SectionSettings(**bad)
        with pytest.raises(ValueError):
            Defaults(**bad)
    assert load_section(tmp_path) is None


def test_http_embedder(monkeypatch):
    answers = []
    monkeypatch.setattr(HttpEmbedder, "_post", lambda self, body: answers.pop(0))
    e = HttpEmbedder("http://x")
    assert e.embed("m", []) == []
    answers.append({"data": [{"embedding": [2.0], "index": 1}, {"embedding": [1.0], "index": 0}]})
    assert e.embed("m", ["a", "b"]) == [[1.0], [2.0]]
    for bad in ({}, {"data": []}):
        answers.append(bad)
        with pytest.raises(EmbedError):
            e.embed("m", ["a"])


def test_http_retries(monkeypatch):
    import io
    import json
    import urllib.error
    import urllib.request

    calls = []

    def answer(codes):
        def call(request, timeout):
            calls.append(1)
            code = codes.pop(0)
            if code == "timeout":
                raise TimeoutError
            if code == "refused":
                raise urllib.error.URLError("refused")
            if code != 200:
                raise urllib.error.HTTPError("u", code, "", {}, io.BytesIO())
            return io.StringIO(json.dumps({"data": [{"embedding": [1.0]}]}))

        return call

    e = HttpEmbedder("http://x", backoff=0)
    for codes, n in (([503, "refused", 200], 3), ([200], 1)):
        calls.clear()
        monkeypatch.setattr(urllib.request, "urlopen", answer(codes))
        assert e.embed("m", ["a"]) == [[1.0]] and len(calls) == n
    for codes, n in ((["timeout", 200], 1), ([400, 200], 1), ([502] * 4, 4)):
        calls.clear()
        monkeypatch.setattr(urllib.request, "urlopen", answer(codes))
        with pytest.raises(EmbedError):
            e.embed("m", ["a"])
        assert len(calls) == n


def test_loops(engine, wiki):
    from tessera.plans import daemon

    engine.ingest()
    (wiki / "kin.md").unlink()
    object.__setattr__(engine.config, "daemon_poll_seconds", 0.1)
    stop, threads = daemon.start(engine)
    for _ in range(600):
        if engine.store.row("docs", "kin.md")["delete_after"]:
            break
    stop.set()
    for t in threads:
        t.join(60)
    assert not any(t.is_alive() for t in threads) and engine.health.snapshot()[0]["status"] == "healthy"
    engine.now[0] += timedelta(days=8)
    assert daemon.purge_report(engine) == {"sections": {"docs": ["kin.md"]}, "total": 1}
    assert engine.store.available() and not HttpEmbedder("http://127.0.0.1:9").available()


def test_health():
    Flaky.broken = False
    h = HealthRegistry(Flaky(8), ["b", "a"])
    assert not h.blocked("a")
    Flaky.broken = True
    assert h.check("a").status == "unhealthy" and h.blocked("a")
    Flaky.broken = False
    assert [x.model for x in h.recheck()] == ["a"] and h.get("a").embedding_dim == 8
    assert [x["model"] for x in h.snapshot()] == ["a", "b"]


def test_streaming(spark, tmp_path):
    from tessera.streaming.ingest import FILES, ingest_batch, start

    store = Store(spark, f"file://{tmp_path}/store")
    put = lambda name, rows: spark.createDataFrame(rows, FILES).write.parquet(f"file://{tmp_path}/in/{name}")
    (tmp_path / "in").mkdir()
    run = lambda: start(spark, f"file://{tmp_path}/in/*", store, HashEmbedder(8), f"file://{tmp_path}/check", once=True).awaitTermination()
    put("one", [("s", "a.md", "Hello world."), ("s", "b.md", "")])
    run()
    put("two", [("s", "a.md", "Hello again."), ("s", "c.md", "Third.")])
    run()
    run()
    rows = {r["rel_path"]: (r["status"], r["total_chunks"]) for r in store.files("s").collect()}
    assert rows == {"a.md": ("ingested", 1), "b.md": ("ingested", 0), "c.md": ("ingested", 1)}
    before = store.points().count()
    ingest_batch(store, spark.createDataFrame([("s", "c.md", "Third.")], FILES), HashEmbedder(8), "nomic-embed-text", 512, 51)  # a batch that runs again
    assert store.points().count() == before


def test_posting_lists_of_a_section(engine, wiki):
    """Searches use the lists while the section is as it was, and give what a scan gives, hidden points and their counts included."""
    engine.ingest()
    scan = engine.search("docs", "the memory of a grandmother", 5, "keyword")["results"]
    assert engine.index("docs") and not engine.index("docs") and len(scan) == 2
    assert engine.search("docs", "the memory of a grandmother", 5, "keyword")["results"] == scan
    (wiki / "kin.md").unlink()
    engine.poll()
    assert engine.store.index_folders("docs", engine.store.stamp("docs")) == []
    scan = engine.search("docs", "the memory", 5, "keyword")["results"]
    assert engine.index("docs") and engine.search("docs", "the memory", 5, "keyword")["results"] == scan and len(scan) == 1
    assert len(engine.store._names("index/s-docs")) == 1
