"""The engine's interface: sections, search, navigation, ingestion, status, and maintenance."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import content_hash, index_of, point_id
from tessera.operators import chunking, gates, lifecycle, navigation, search, sparse
from tessera.operators.postings import PostingIndex
from tessera.sources import parsing
from tessera.sources.config import Config, discover_sections
from tessera.sources.discovery import content, discover_files
from tessera.sources.embedding import Embedder, dimension, embed_udf

from .health import HealthRegistry
from .store import STATUSES, Store

MODES = ("keyword", "semantic", "hybrid")
KEYS = ["section", "source_file", "chunk_index", "id"]
#: Files that a task reads and parses, or so: a table of paths is small, so tasks aren't cut by its bytes.
FILES_A_TASK = 500
#: A run has so many batches at most, as each costs some twenty small jobs; beyond, batches are larger, and their tasks are more.
MOST_BATCHES = 16
RESULT = ["text", "source_file", "page_number", "chunk_index", "section", "score"]


@dataclass
class Summary:
    """What an ingestion did."""

    status: str = "completed"  # completed, already_running or failed
    reason: str | None = None
    reset: bool = False
    new: int = 0
    changed: int = 0
    unchanged: int = 0
    resumed: int = 0
    moved: int = 0
    restored: int = 0
    errored: int = 0
    skipped: int = 0


class Engine:
    def __init__(self, spark: SparkSession, config: Config, store: Store, embedder: Embedder, counters: dict[str, Callable[[str], int]] | None = None, parser: parsing.Parser = parsing.pdf_pages, batch_files: int = 10_000):
        """``batch_files`` files at most, or so, are parsed, embedded and committed together: what a crash repeats. Of runs of more than MOST_BATCHES times as many files it is their share of one batch."""
        self.batch_files = batch_files
        self.spark, self.config, self.store, self.embedder, self.parser = spark, config, store, embedder, parser
        self.counters = counters or {}
        self.health = HealthRegistry(embedder, config.models or [config.defaults.embed_model])
        self.runs: dict[str, dict[str, Any]] = {}

    # configuration

    def resolved(self) -> DataFrame:
        return discover_sections(self.spark, self.config)

    def section(self, name: str) -> Row | None:
        return self.resolved().filter(F.col("section") == name).first()

    def disk(self, section: Row, hashes: bool = False) -> DataFrame:
        """What there is to take in a section; ``hashes`` reads every file."""
        f = discover_files(self.spark, section["path"], self.config.size_cap_text_bytes, self.config.size_cap_other_bytes)
        f = f.withColumn("section", F.lit(section["section"]))
        return f.withColumn("content", content("path")).withColumn("content_hash", content_hash(F.col("content"))) if hashes else f

    def sections(self) -> list[dict]:
        return [r.asDict() for r in self.resolved().select("section", "description", "enabled", "disabled_reason").collect()]

    def section_details(self, name: str) -> dict:
        s = self.section(name)
        if s is None:
            return {"error": f"there is no section {name}"}
        taken = self.disk(s).filter("skip_reason IS NULL") if s["enabled"] else self.disk(s).limit(0)
        with self.store.work() as keep:
            found = gates.coverage(keep(taken.select("section", "rel_path")), keep(self.store.files(name))).first()
        return {**s.asDict(), "coverage": found.asDict() if found else {}}

    # search

    def live_points(self, section: str) -> DataFrame:
        """Points that searches see; other sections' tables aren't read."""
        return lifecycle.in_use(self.store.points(section), self.store.files(section)).withColumn("in_use", F.lit(True))

    def search(self, section: str, query: str, top_k: int = 3, mode: str = "hybrid", allow_incomplete: bool = False) -> dict:
        """{results, warnings} or {error}. Gates come first: whether the section can be searched, whether its vectors are valid (dense modes can't do
        without; keyword warns), and whether all files are indexed (which ``allow_incomplete`` turns into a warning).
        """
        if mode not in MODES:
            return {"error": f"mode {mode} is none of {', '.join(MODES)}"}
        s = self.section(section)
        stored = self.store.fingerprints(section)
        if (problem := self._not_queryable(section, s, stored)) is not None:
            return {"error": problem}
        warnings = []
        mine = self.spark.createDataFrame([(section, s["embed_model"], s["chunk_size"], s["chunk_overlap"])], "section string, embed_model string, chunk_size int, chunk_overlap int")
        valid = gates.validity(mine, stored).first()
        if not valid["valid"]:
            if mode != "keyword":
                return {"error": f"vectors are out of date: {valid['reason']}"}
            warnings.append(f"vectors are out of date: {valid['reason']}")
        with self.store.work() as keep:  # verdicts look at files twice; they are opened once
            done = gates.verdicts(keep(gates.completeness(self.disk(s).filter("skip_reason IS NULL"), self.store.files(section)))).first()
        if done and not done["complete"]:
            note = {"summary": done["summary"], **{c: done[c] for c in gates.CATEGORIES}}
            if not allow_incomplete:
                return {"error": "the section is incomplete", "incomplete": note}
            warnings.append(f"the section is incomplete: {done['summary']}")
        arms, points = [], self.live_points(section)
        if mode != "semantic":
            arms.append(self.keyword_scores(section, points, query, search.PREFETCH * top_k))
        if mode != "keyword":
            model = s["embed_model"]
            if self.health.blocked(model):
                return {"error": f"model {model} is {self.health.get(model).status}: {self.health.get(model).error}"}
            try:
                vector = self.embedder.embed(model, [query])[0]
                self.health.mark(model, dim=len(vector))
            except Exception as e:  # noqa: BLE001
                self.health.mark(model, error=str(e))
                return {"error": f"the query can't be embedded: {e}"}
            arms.append(search.vector_scores(points, vector, KEYS))
        best = search.hybrid(*arms, top_k, KEYS) if len(arms) == 2 else search.top(arms[0], top_k, KEYS)
        # ids follow from version and place, so those of the best are live; their texts are found by one scan
        out = self.store.points(section).join(F.broadcast(best.select("id", "score")), "id").orderBy(F.desc("score"), *KEYS)
        return {"results": [r.asDict() for r in out.select(*RESULT).collect()], "warnings": warnings}

    def index(self, section: str) -> bool:
        """Build posting lists of what searches see of a section, unless there are some of its state: keyword searches then read only ranges of points that can matter, until the section changes. Returns whether they were built."""
        stamp = self.store.stamp(section)
        if self.store.index_folders(section, stamp):
            return False
        terms = F.arrays_zip(F.col("indices").cast("array<string>").alias("term"), F.col("values").alias("tf"))
        PostingIndex.build(self.live_points(section), f"{self.store.path}/{self.store._folder('index', section)}/{stamp}", KEYS, counted=F.coalesce(terms, F.array().cast("array<struct<term:string,tf:double>>")))
        self.store.drop_indexes(section, stamp)
        return True

    def keyword_scores(self, section: str, live: DataFrame, query: str, k: int) -> DataFrame:
        """Scores over hashed terms; document frequencies are those of all the section's points, from the counts that the store keeps. With posting lists of the section's state, its ``k`` best; else of all points, whose
        arrays are cut to the query's indices where they lie, so nothing shuffles."""
        asked: dict[int, int] = {}
        for r in search.query_terms(self.spark, query).collect():  # a query's terms; those of one index are added up
            asked[index_of(r["term"])] = asked.get(index_of(r["term"]), 0) + r["qtf"]
        counted = self.store.term_counts(section, list(asked)) if asked else (0, {})
        if asked and k > 0 and (found := self.store.index_folders(section, self.store.stamp(section))):
            return PostingIndex.open(self.spark, found[0]).search({str(i): n for i, n in asked.items()}, k, (counted[0], {str(i): n for i, n in counted[1].items()}))
        return search.array_scores(live, live, asked, KEYS, counted=counted)

    @staticmethod
    def _not_queryable(name: str, s: Row | None, stored: DataFrame) -> str | None:
        if s is None:
            return f"there is no section {name}"
        if not s["enabled"]:
            return f"section {name} is disabled: {s['disabled_reason']}"
        if not stored.limit(1).take(1):
            return f"section {name} has not been ingested"
        return None

    def list_files(self, section: str) -> dict:
        """Neither gate applies to navigation."""
        if problem := self._not_queryable(section, self.section(section), self.store.fingerprints(section)):
            return {"error": problem}
        return {"files": [r.asDict() for r in navigation.list_files(self.live_points(section)).collect()]}

    def get_chunks(self, section: str, source_file: str, start: int = 0, count: int = 10) -> dict:
        if problem := self._not_queryable(section, self.section(section), self.store.fingerprints(section)):
            return {"error": problem}
        return {"chunks": [r.asDict() for r in navigation.get_chunks(self.live_points(section), source_file, start, count).collect()]}

    # ingestion

    def ingest(self, section: str = "all", wait: bool = True) -> dict:
        """Ingest a section, or all that are enabled; state of sections that are gone is removed with ``all``. A run is a thread; its jobs are Spark's."""
        names = [r["section"] for r in self.resolved().filter("enabled").collect()] if section == "all" else [section]
        s = None if section == "all" else self.section(section)
        if section != "all" and (s is None or not s["enabled"]):
            return {"error": f"there is no section {section}" if s is None else f"section {section} is disabled: {s['disabled_reason']}"}
        if section == "all":
            self.clean_orphans()
        busy = [n for n in names if self.runs.get(n, {}).get("status") in ("pending", "running")]
        threads = []
        for n in names:
            if n not in busy:
                self.runs[n] = {"status": "pending", "started": datetime.now(), "finished": None, "error": None, "summary": None}
                threads.append(threading.Thread(target=self._run, args=(n,)))
        for t in threads:
            t.start()
            if wait:
                t.join()
        return {"started": [n for n in names if n not in busy], "already_running": busy}

    def _run(self, name: str) -> None:
        run = self.runs[name]
        run["status"] = "running"
        try:
            summary = self.ingest_section(name)
            run |= {"status": "failed" if summary.status == "failed" else "completed", "summary": asdict(summary), "error": summary.reason}
        except Exception as e:  # noqa: BLE001  a run reports what ended it
            run |= {"status": "failed", "error": str(e)}
        run["finished"] = datetime.now()

    def ingest_section(self, name: str) -> Summary:
        with self.store.lock(name) as mine:
            return self._ingest(self.section(name)) if mine else Summary("already_running")

    def _ingest(self, s: Row) -> Summary:
        name, model, out = s["section"], s["embed_model"], Summary()
        try:
            dimension(self.embedder, model)
        except Exception as e:  # noqa: BLE001
            return Summary("failed", f"the embedder fails: {e}")
        stored = self.store.fingerprints().filter(F.col("section") == name).first()
        if stored and any(stored[k] != s[k] for k in ("embed_model", "chunk_size", "chunk_overlap")):
            self.store.drop_section(name)
            out.reset = True
        self.store.ensure_section(name, model, s["chunk_size"], s["chunk_overlap"])
        with self.store.work() as keep:
            found = keep(self.disk(s, hashes=True).drop("content"))  # read and hashed once
            state = self.store.files(name)
            skips = found.filter("skip_reason IS NOT NULL")
            status = F.when(F.col("skip_reason").startswith("too_large"), "skipped_size").when(F.col("skip_reason") == "binary", "skipped_binary").when(F.col("skip_reason").startswith("unreadable"), "error")
            skips = skips.select("section", "rel_path", "size", status.alias("status"), F.col("skip_reason").alias("reason")).filter("status IS NOT NULL")
            for r in skips.groupBy(F.col("status") == "error").agg(F.count("*")).collect():
                setattr(out, "errored" if r[0] else "skipped", r[1])
            self._set_aside(skips, state)
            taken = found.filter("skip_reason IS NULL")
            plan = keep(lifecycle.dispatch(taken.select("section", "rel_path", "content_hash", "walk_order"), state, "walk_order"))
            for r in plan.groupBy("action").count().collect():
                setattr(out, r["action"], r["count"])
            if out.moved:
                self.move(name, plan.filter("action = 'moved'").select("section", F.col("moved_from").alias("source_file"), F.col("rel_path").alias("new_path"), "content_hash"))
            if out.restored:
                rows = state.join(plan.filter("action = 'restored'").select("rel_path"), "rel_path")
                self.store.change(rows, in_use=True, delete_after=F.lit(None).cast("timestamp"))
            todo = out.new + out.changed + out.resumed
            batches = min(MOST_BATCHES, -(-todo // self.batch_files))
            fresh = taken.join(plan.filter("action IN ('new', 'changed', 'resumed')").select("rel_path", "action"), "rel_path")
            fresh = keep(fresh.withColumn("batch", F.pmod(F.xxhash64("rel_path"), F.lit(max(1, batches)))), "batch") if batches > 1 else fresh.withColumn("batch", F.lit(0).cast("long"))
            # a batch is a folder, and opens no other's files
            parts = [fresh.filter(F.col("batch") == k).drop("batch").repartition(-(-todo // batches // FILES_A_TASK)) for k in range(batches)]
            any_pdf = bool(todo and fresh.filter(parsing.is_pdf()).count())
            with ThreadPoolExecutor(1) as ahead:  # the next batch is chunked while one is embedded and committed
                following = ahead.submit(self._chunked, s, parts[0], keep, any_pdf) if parts else None
                for k in range(batches):
                    chunked = following.result()
                    if k + 1 < batches:
                        following = ahead.submit(self._chunked, s, parts[k + 1], keep, any_pdf)
                    out.errored += self._store(s, chunked, keep, out.changed + out.resumed == 0)
        self.store.mark_ingested(name)
        return out

    def _set_aside(self, rows: DataFrame, state: DataFrame) -> None:
        """One write for files (section, rel_path, size, status, reason) that are skipped or in error. Skipped ones go out of use; one in error keeps its hash, size and
        use, and is out of use if it is new. Rows that say the same already are left.
        """
        old, error = state.select("rel_path", *[F.col(c).alias(f"__{c}") for c in ("content_hash", "size", "mtime", "total_chunks", "chunks_done", "in_use", "delete_after", "status", "error_reason")]), F.col("status") == "error"
        both = rows.join(old, "rel_path", "left_outer")
        same = F.col("__status").eqNullSafe(F.col("status")) & F.col("__error_reason").eqNullSafe(F.col("reason")) & (error | F.col("__size").eqNullSafe(F.col("size")))
        both = both.filter(~same).select(
            "section", "rel_path", F.coalesce("__content_hash", F.lit("")).alias("content_hash"), F.coalesce(F.when(error, F.col("__size")), "size", F.lit(0)).cast("long").alias("size"), F.col("__mtime").alias("mtime"),
            F.coalesce("__total_chunks", F.lit(0)).alias("total_chunks"), F.coalesce("__chunks_done", F.lit(0)).alias("chunks_done"), (error & F.coalesce("__in_use", F.lit(False))).alias("in_use"), "status",
            F.col("reason").alias("error_reason"), F.col("__delete_after").alias("delete_after"), F.lit(None).cast("timestamp").alias("updated_at"),
        )
        self.store.append(both)

    def _chunked(self, s: Row, files: DataFrame, keep, any_pdf: bool) -> DataFrame:
        """A batch of files as a table of theirs: parse_error, chunks (an array) and how many they are. A text is read, parsed and cut in its row."""
        count = self.counters.get(s["embed_model"], chunking.estimate_tokens)
        parsed = parsing.parse(files.withColumn("content", content("path")), self.parser, any_pdf)
        made = parsed.withColumn("chunks", chunking.chunker(count)("pages", F.lit(s["chunk_size"]), F.lit(s["chunk_overlap"]))).withColumn("total_chunks", F.size("chunks"))
        return keep(made.select("section", "rel_path", "content_hash", "size", "mtime", "action", "parse_error", "total_chunks", "chunks"))

    def _store(self, s: Row, chunked: DataFrame, keep, new: bool = False) -> int:
        """Embed a batch of chunked files; intents first, then points and, last, the commits. Returns how many files failed. ``new``: no file of the run was there before, so no points have to go.

        A file that can't be parsed keeps its row and points. Chunks that can't be embedded put their file in error; the others of the file are stored, and as points of the
        same id aren't embedded again, its next ingest goes on from there, as does one after a crash.
        """
        name = s["section"]
        bad = chunked.filter("parse_error IS NOT NULL").select("section", "rel_path", "size", F.lit("error").alias("status"), F.col("parse_error").alias("reason"))
        good = chunked.filter("parse_error IS NULL")
        rows = good.select("section", "rel_path", "content_hash", "size", "mtime", "total_chunks")
        self.store.begin_all(rows, name)
        chunks = good.select("section", F.col("rel_path").alias("source_file"), "content_hash", "action", F.explode("chunks").alias("c")).select("*", "c.*").drop("c")
        chunks = chunks.withColumn("id", point_id(F.col("section"), F.col("source_file"), F.col("content_hash"), F.col("chunk_index")))
        # chunks of a resumed file that are stored already have their ids there, and aren't embedded again; a new file has none, so points aren't read for it
        todo = chunks.drop("action")
        if not new:
            old = chunks.filter("action <> 'new'").drop("action").join(self.store.points(name).select("id"), "id", "left_anti")
            todo = chunks.filter("action = 'new'").drop("action").unionByName(old)
        todo = todo.withColumn("e", embed_udf(self.embedder, s["embed_model"], s["embed_batch_size"])("text"))
        # embedded and written once, as the points that they become unless the embedder fails
        staged = self.store.stage_points(name, sparse.with_vectors(todo.withColumns({"dense": F.col("e.vector"), "error": F.col("e.error")}).drop("e")))
        failed = self.store.staged(staged).filter("error IS NOT NULL").select("source_file", "error")
        unparsed, unembedded = bad.count(), failed.count()
        # only files that were there before can have points of other versions
        gone = None if new else good.filter("action <> 'new'").select(F.col("rel_path").alias("source_file"), F.col("content_hash").alias("keep_hash"))
        # the intents, which nobody else changes while this writer has the section, so the section's state isn't read
        done = rows.withColumns({"reason": F.lit(None).cast("string"), "missing": F.lit(0)})
        if unembedded:
            failed = keep(failed.groupBy(F.col("source_file").alias("rel_path")).agg(F.min("error").alias("reason"), F.count("*").cast("int").alias("missing")))
            done, unembedded = rows.join(failed, "rel_path", "left_outer"), failed.count()
            self.store.commit_points(name, lambda _: (self.store.staged(staged).filter("error IS NULL"), gone))
            self.store.drop_staged(staged)
        else:
            self.store.commit_points(name, lambda _: (staged, gone))
        columns = {"status": F.when(F.col("reason").isNull(), "ingested").otherwise("error"), "error_reason": F.col("reason"), "chunks_done": F.col("total_chunks") - F.coalesce("missing", F.lit(0))}
        self.store.change(done.withColumns({"in_use": F.lit(True), "delete_after": F.lit(None).cast("timestamp")}), name, **columns)
        if unparsed:
            self._set_aside(bad, self.store.files(name))
        return unparsed + unembedded

    def move(self, name: str, moves: DataFrame) -> None:
        """New paths and ids for points and rows of a section; (section, source_file, new_path, content_hash)."""
        self.store.move_points(name, moves)
        m = moves.select("section", F.col("source_file").alias("rel_path"), "new_path")
        rows = self.store.files(name).join(m, ["section", "rel_path"])
        gone = rows.drop("new_path").withColumn("deleted", F.lit(True))
        here = rows.withColumns({"rel_path": F.col("new_path"), "in_use": F.lit(True), "delete_after": F.lit(None).cast("timestamp"), "deleted": F.lit(False)}).drop("new_path")
        self.store.append(gone.unionByName(here))

    # maintenance

    def poll(self) -> dict[str, dict[str, int]]:
        """One pass of the daemon over enabled sections that nobody else works on: hides changed files, moves moved ones, marks deleted ones."""
        out = {}
        for s in self.resolved().filter("enabled").collect():
            with self.store.lock(s["section"]) as mine:
                if mine:
                    out[s["section"]] = self._scan(s)
        return out

    def _scan(self, s: Row) -> dict[str, int]:
        name = s["section"]
        state = self.store.files(name)
        with self.store.work() as keep:
            disk = keep(self.disk(s, hashes=True).filter("skip_reason IS NULL").select("section", "rel_path", "content_hash", "size", "mtime", "walk_order"))  # read and hashed once
            diff = keep(lifecycle.daemon_diff(disk, state, "walk_order"))
            counts = {r["action"]: r["count"] for r in diff.groupBy("action").count().collect()}
            moves = diff.filter("action = 'move'").join(state.select("rel_path", "content_hash"), "rel_path")
            if counts.get("move"):
                self.move(name, moves.select("section", F.col("rel_path").alias("source_file"), "new_path", "content_hash"))
            none = F.lit(None).cast("timestamp")
            if counts.get("changed"):
                self.store.change(state.join(diff.filter("action = 'changed'").select("rel_path"), "rel_path", "left_semi"), in_use=False, delete_after=none)
            if counts.get("delete"):
                after = F.lit(self.store.clock() + timedelta(days=self.config.deletion_grace_days))
                self.store.change(state.join(diff.filter("action = 'delete'").select("rel_path"), "rel_path", "left_semi"), in_use=False, delete_after=after)
        return counts

    def purge(self) -> dict[str, list[str] | str]:
        """Remove points and rows whose grace is over; sections that are in use elsewhere are passed over."""
        out: dict[str, list[str] | str] = {}
        now = F.lit(self.store.clock())
        for (name,) in lifecycle.expired(self.store.files(), now).select("section").distinct().collect():
            with self.store.lock(name) as mine:
                if not mine:
                    out[name] = "skipped (locked)"
                    continue
                state = self.store.files(name)
                dead = lifecycle.expired(state, now)
                names = [r["rel_path"] for r in dead.select("rel_path").collect()]
                self.store.delete_points(name, dead.select(F.col("rel_path").alias("source_file")))
                self.store.append(dead.withColumn("deleted", F.lit(True)))
                out[name] = names
        return out

    def clean_orphans(self) -> list[str]:
        """Drop what is stored of sections that are no longer on disk."""
        gone = [r[0] for r in lifecycle.orphans(self.store.fingerprints(), self.resolved().select("section")).collect()]
        for name in gone:
            self.store.drop_section(name)
        return gone

    def status(self, filters: dict[str, Any] | None = None) -> dict:
        """Blocks sections, models and health; with filters, those whose key is there. An empty list of names is all."""
        filters = filters if filters is not None else {"sections": [], "models": [], "health": True}
        out: dict[str, Any] = {}
        if "sections" in filters:
            s = self.store.files()
            if filters["sections"]:
                s = s.filter(F.col("section").isin(*filters["sections"]))
            rows = s.groupBy("section").agg(*[F.count_if(F.col("status") == k).alias(k) for k in STATUSES])
            out["sections"] = {r["section"]: {**r.asDict(), "errors": [], "skipped": [], "run": self.runs.get(r["section"])} for r in rows.collect()}
            for r in s.filter("status LIKE 'skipped%' OR status = 'error'").select("section", "status", "rel_path", "error_reason").orderBy("section", "rel_path").toLocalIterator():
                out["sections"][r["section"]]["errors" if r["status"] == "error" else "skipped"].append({"rel_path": r["rel_path"], "error_reason": r["error_reason"]})
        if "models" in filters:
            out["models"] = [h for h in self.health.snapshot() if not filters["models"] or h["model"] in filters["models"]]
        if "health" in filters:
            out["health"] = {"store": self.store.available(), "embedder": all(h["status"] != "unhealthy" for h in self.health.snapshot())}
        return out
