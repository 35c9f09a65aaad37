"""The engine's queries over the test tables, and the SQL that DuckDB checks them with."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import files as file_functions
from tessera.functions import identity, text
from tessera.operators import chunking, gates, lifecycle, navigation, search, sparse
from tessera.operators.postings import PostingIndex
from tessera.operators.vector_index import VectorIndex, recall
from tessera.plans import fixtures
from tessera.plans.engine import Engine
from tessera.plans.store import POINT, Store
from tessera.sources.config import Config
from tessera.sources.embedding import HashEmbedder
from tessera.streaming import lifecycle as file_lifecycle

QUERY = "the attion the language edinth the"
QUERY_VECTOR_ID = 7
CHUNK_SIZE, CHUNK_OVERLAP = 50, 10
MODEL = "nomic-embed-text"


def _dense(spark: SparkSession, sf_dir: str) -> list[float]:
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").first()
    return list(row[0])


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.points(spark, sf_dir).filter("in_use")


def _keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = {r["term"]: r["qtf"] for r in search.query_terms(spark, QUERY).collect()}
    return search.keyword_scores(_live(spark, sf_dir), query, ["source_file"])


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_keyword_scores(spark, sf_dir), 10, ["source_file"]).select("source_file", F.round("score", 6).alias("score"))


def _vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_scores(_live(spark, sf_dir).filter("dense IS NOT NULL"), _dense(spark, sf_dir), ["source_file"])


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_vector_scores(spark, sf_dir), 10, ["source_file"]).select("source_file", F.round("score", 6).alias("score"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.hybrid(_keyword_scores(spark, sf_dir), _vector_scores(spark, sf_dir), 10, ["source_file"])
    return out.select("source_file", F.round("score", 6).alias("score"))


def sparse_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_frequencies(fixtures.points(spark, sf_dir), ["doc_id"])


def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.points(spark, sf_dir)
    df = sparse.document_frequencies(sparse.term_frequencies(p, ["doc_id"]))
    return df.select("term", "df", F.round(sparse.idf(F.lit(p.count()), F.col("df")), 6).alias("idf"))


def query_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents for the text of each benchmark item."""
    p = _live(spark, sf_dir).select("source_file", "text")
    queries = sparse.term_frequencies(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["item_id"]).withColumnRenamed("tf", "qtf")
    scores = search.keyword_batch(p, queries, ["source_file"], ["item_id"])
    return search.top_by(scores, 3, ["item_id"], ["source_file"]).select("item_id", "source_file", "rank", F.round("score", 5).alias("score"))


def semantic_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each vector whose id is divisible by 50, a stated set of queries."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    scores = search.nearest(e, queries, 5, "vec_id", "query_id", "embedding")
    return scores.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword_topk`` from posting lists: the index of all live points is built, and only ranges that can still matter are read."""
    index = PostingIndex.build(_live(spark, sf_dir), _scratch(spark), ["source_file"])
    query = {r["term"]: r["qtf"] for r in search.query_terms(spark, QUERY).collect()}
    return index.search(query, 10).select("source_file", F.round("score", 6).alias("score"))


def query_batch_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_batch_topk`` from posting lists: all queries at once, each with its own threshold."""
    index = PostingIndex.build(_live(spark, sf_dir), _scratch(spark), ["source_file"])
    queries = sparse.term_frequencies(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["item_id"]).withColumnRenamed("tf", "qtf")
    return index.search_all(queries, 3, ["item_id"]).select("item_id", "source_file", "rank", F.round("score", 5).alias("score"))


def _vector_queries(e: DataFrame) -> DataFrame:
    return e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``semantic_batch_topk`` by the vector index, ten rows a query: nearly the same ids, and exact scores."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = VectorIndex.build(e, _scratch(spark), "vec_id", "embedding").search(_vector_queries(e), 10, "query_id", "embedding")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against the exact search: how many queries there are, and whether at least nine in ten of their ten nearest rows are found."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    exact = search.nearest(e, _vector_queries(e), 10, "vec_id", "query_id", "embedding")
    out = recall(vector_index_topk(spark, sf_dir), exact, "query_id", "vec_id")
    return out.select("queries", "wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("reached"))


def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.files(spark, sf_dir)
    return f.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("chars"))


def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.files(spark, sf_dir)
    return f.select("doc_id", F.posexplode(text.pack_sentences(F.col("text"), CHUNK_SIZE)).alias("piece", "text")).select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.files(spark, sf_dir).select("doc_id", F.array(F.struct("text", F.lit(0).alias("page_number"))).alias("pages"))
    return chunking.chunk(f, CHUNK_SIZE, CHUNK_OVERLAP)


def chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a page for each turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct((F.col("turn") + 1).cast("int").alias("page_number"), "text").alias("p"))
    pages = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    pages = pages.withColumn("pages", F.transform("pages", lambda p: F.struct(p["text"].alias("text"), p["page_number"].alias("page_number"))))
    return chunking.chunk(pages, CHUNK_SIZE, CHUNK_OVERLAP)


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made of orders: a heading, a table of an order's lines and a fenced list, through every branch of the chunker."""
    row = F.concat_ws(" | ", F.lit(""), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit(""))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.trim(row).alias("row")))).alias("rows"))
    table = F.array_join(F.col("rows.row"), "\n")
    code = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("part_"), r["l_linenumber"].cast("string"), F.lit(" = "), r["row"])), "\n")
    body = F.concat(F.lit("# Order "), F.col("l_orderkey").cast("string"), F.lit("\n\nIt has lines. They follow.\n\n| line | part | n |\n| --- | --- | --- |\n"), table, F.lit("\n\n```text\n"), code, F.lit("\n```\n"))
    return chunking.chunk(lines.select("l_orderkey", F.array(F.struct(body.alias("text"), F.lit(0).alias("page_number"))).alias("pages")), 32, 8)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir).select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by hash: every hash that several files share, with their number and first path."""
    f = fixtures.files(spark, sf_dir)
    return f.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("rel_path").alias("first_path")).filter("n > 1")


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.points(spark, sf_dir)
    return p.select("doc_id", identity.point_id(F.col("section"), F.col("source_file"), F.col("content_hash"), F.col("chunk_index")).alias("id"))


def term_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = sparse.term_frequencies(fixtures.points(spark, sf_dir), ["doc_id"]).select("term").distinct()
    return terms.select("term", identity.term_index("term").alias("idx"))


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.text_vectors(fixtures.points(spark, sf_dir), ["doc_id"])


def classify_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    ext = file_functions.extension(path)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ext.alias("ext"), file_functions.classify(ext).alias("file_class"))


def size_cap_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip reasons with a small cap; every thirteenth file is given a NUL."""
    f = fixtures.files(spark, sf_dir)
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(F.col("doc_id") % 5 == 0, "other").when(F.col("doc_id") % 17 == 0, "known_binary").otherwise("known_text")
    return f.select("doc_id", kind.alias("file_class"), file_functions.skip_reason(kind, F.col("size"), content, 5000, 1000).alias("skip_reason"))


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.list_files(fixtures.chunk_points(spark, sf_dir))


def get_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.get_chunks(fixtures.chunk_points(spark, sf_dir), "conv_3", 1, 4)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved settings of sections: those whose name ends in 3 ask for another size, in 5 for another model."""
    s = fixtures.files(spark, sf_dir).select("section").distinct()
    size = F.when(F.col("section").endswith("3"), 256).otherwise(512)
    return s.select("section", F.when(F.col("section").endswith("5"), "other-model").otherwise(MODEL).alias("embed_model"), size.alias("chunk_size"), (size * 0.1).cast("int").alias("chunk_overlap"))


def section_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw settings over defaults and a model registry: empty or missing settings inherit; what doesn't fit is disabled with a reason."""
    from tessera.sources.config import resolve

    s = fixtures.files(spark, sf_dir).select("section").distinct()
    n = F.regexp_extract("section", "([0-9]+)$", 1).cast("int")
    raw = s.select("section", F.when(n % 3 == 0, "").when(n % 3 == 1, F.lit("big")).when(n % 7 == 5, "missing").alias("embed_model"), F.when(n % 4 == 1, 600).when(n % 4 == 3, 2000).alias("chunk_size"), F.when(n % 5 == 2, 0.25).alias("chunk_overlap_ratio"), F.lit(None).cast("double").alias("headroom_ratio"))
    models = spark.createDataFrame([(MODEL, 2048, 16), ("big", 8192, 32)], "model string, max_context int, embed_batch_size int")
    return resolve(raw, models, {"embed_model": MODEL, "chunk_size": 512, "chunk_overlap_ratio": 0.1, "headroom_ratio": 0.02})


def validity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    stored = s.filter("section <> 'src1'").select("section", F.lit(MODEL).alias("embed_model"), F.lit(512).alias("chunk_size"), F.lit(51).alias("chunk_overlap"))
    return gates.validity(s, stored)


def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.completeness(fixtures.files(spark, sf_dir), fixtures.state(spark, sf_dir))


def completeness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.verdicts(completeness_gate(spark, sf_dir), sample=3)
    return out.select("section", "complete", "summary", *[F.array_join(c, ";").alias(c) for c in gates.CATEGORIES])


def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.coverage(fixtures.files(spark, sf_dir), fixtures.state(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of states, and the files in error or skipped, by section."""
    s = fixtures.state(spark, sf_dir)
    names = lambda status: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.concat_ws(":", "rel_path", "error_reason")))), ";")
    return s.groupBy("section").agg(*[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("ingested", "ingesting", "error", "skipped_size")], names("error").alias("errors"), names("skipped_size").alias("skipped"))


def ingest_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.dispatch(fixtures.files(spark, sf_dir).select("section", "rel_path", "content_hash"), fixtures.state(spark, sf_dir))


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_dispatch(spark, sf_dir).groupBy("section", "action").agg(F.count("*").alias("n"))


def daemon_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.daemon_diff(fixtures.files(spark, sf_dir).select("section", "rel_path", "content_hash", "size", "mtime"), fixtures.state(spark, sf_dir))


def cheap_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test before hashing, with stored times up to 2 ms off."""
    f = fixtures.files(spark, sf_dir)
    off = F.timestamp_micros(F.unix_micros("mtime") + (F.col("doc_id") % 5) * 500)
    stored = F.when(F.col("doc_id") % 9 != 0, off)
    return f.select("doc_id", lifecycle.looks_changed(F.col("size"), F.col("mtime"), F.when(F.col("doc_id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")), stored).alias("changed"))


def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expired(fixtures.state(spark, sf_dir), F.lit(fixtures.NOW).cast("timestamp")).select("section", "rel_path")


def purge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge_expired(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n"))


def orphan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.state(spark, sf_dir)
    return lifecycle.orphans(s, s.filter("NOT section LIKE '%7'").select("section").distinct())


def repath_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at the old paths of moved files take their new paths and ids."""
    moves = ingest_dispatch(spark, sf_dir).filter("action = 'moved'").select("section", F.col("moved_from").alias("source_file"), F.col("rel_path").alias("new_path"), "content_hash")
    s = fixtures.state(spark, sf_dir)
    p = s.select("section", F.col("rel_path").alias("source_file"), "content_hash", F.lit(0).alias("chunk_index"))
    p = p.withColumn("id", identity.point_id(F.col("section"), F.col("source_file"), F.col("content_hash"), F.col("chunk_index")))
    return lifecycle.repath(p, moves)


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows from an event log: events table rows as events of files, some of them deletions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("section"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("rel_path"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("event_id") % 10 == 0).alias("deleted"))
    return lifecycle.latest(log)


def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table replayed as observations of files, by keyed state with timers: an error is a file that isn't found, every other event type a hash; files are purged a day after."""
    base, events = _scratch(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{base}/source")  # a stream's source is a folder
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/source")
    section, file = F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("f"), F.col("user_id").cast("string"))
    seen = F.when(F.col("event_type") != "error", F.sha2("event_type", 256))
    observed = stream.select(section.alias("section"), file.alias("rel_path"), seen.alias("content_hash"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"))
    file_lifecycle.start(spark, observed, timedelta(days=1), f"{base}/actions", f"{base}/checkpoint", once=True).awaitTermination()
    out = spark.read.schema(file_lifecycle.ACTIONS).parquet(f"{base}/actions")
    return out.select("section", "rel_path", "action", F.unix_micros("at").alias("at_us"), "content_hash")


def live_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of files that the state has in use, in the version that it has."""
    p = fixtures.points(spark, sf_dir).drop("dense", "text", "in_use")
    return lifecycle.in_use(p, fixtures.state(spark, sf_dir)).select("doc_id", "section", "source_file")


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def store_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through every transition of the store, by doc_id mod 12, each applied to all such files of a section in one write."""
    store = Store(spark, _scratch(spark), clock=lambda: datetime(2024, 6, 1))
    f = fixtures.files(spark, sf_dir).withColumn("section", F.concat(F.lit("part"), (F.col("doc_id") % 2).cast("string")))
    m = F.pmod(F.regexp_extract("rel_path", "([0-9]+)", 1).cast("long"), F.lit(12))
    store.begin_all(f.select("section", "rel_path", "content_hash", "size", "mtime", (F.col("doc_id") % 5 + 1).cast("int").alias("total_chunks")))
    for (section,) in f.select("section").distinct().collect():
        store.set_chunks_done(section, m == 1, F.least(F.col("total_chunks"), F.lit(2)))
        store.complete(section, m >= 2)
        store.mark_error(section, m == 3, "broken")
        store.record_skip(section, m == 4, "skipped_size", "too_large", 7)
        store.record_skip(section, m == 5, "skipped_binary", "binary", 8)
        store.tombstone(section, m.isin(6, 7), 7)
        store.restore(section, m == 7)
        store.mark_changed(section, m == 8)
        store.repath(section, m == 9, F.concat(F.lit("moved/"), F.col("rel_path")))
        store.delete(section, m == 10)
    return store.files().drop("updated_at", "mtime").withColumn("delete_after", F.date_format("delete_after", "yyyy-MM-dd"))


def store_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by section after an upsert that replaces some ids and adds others, a move, a removal by file, and the drop of a section; with their fingerprints."""
    store = Store(spark, _scratch(spark), clock=lambda: datetime(2024, 6, 1))
    p = fixtures.points(spark, sf_dir).withColumn("section", F.concat(F.lit("part"), (F.col("doc_id") % 2).cast("string")))
    empty = spark.createDataFrame([], POINT)
    p = p.withColumn("id", identity.point_id(F.col("section"), F.col("source_file"), F.col("content_hash"), F.col("chunk_index"))).withColumn("indices", F.array().cast("array<long>")).withColumn("values", F.array().cast("array<double>"))
    rows = p.withColumn("text", F.lit("first")).select("doc_id", *[F.col(c).cast(empty.schema[c].dataType).alias(c) for c in empty.columns])
    store.upsert_points(rows.filter("doc_id % 3 <> 0").drop("doc_id"))
    store.upsert_points(rows.filter("doc_id % 3 <> 1").withColumn("text", F.lit("second")).drop("doc_id"))
    sections = sorted(r[0] for r in rows.select("section").distinct().collect())
    for section in sections:
        store.ensure_section(section, MODEL, 512, 51)
        store.mark_ingested(section)
        store.delete_points(section, store.points(section).filter(F.col("source_file").endswith("7.txt")).select("source_file").distinct())
    store.drop_section(sections[0])
    per = store.points().groupBy("section").agg(F.count("*").alias("points"), F.count_if(F.col("text") == "second").alias("second"), F.min("id").alias("first_id"))
    return per.join(store.fingerprints(), "section").select("section", "points", "second", "first_id", "embed_model", "chunk_size", "chunk_overlap", F.date_format("ingested_at", "yyyy-MM-dd").alias("ingested_on"))


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that the store keeps beside its points, after an upsert that replaces some and adds others, a removal by file and merges: points by term index, and all."""
    store = Store(spark, _scratch(spark), clock=lambda: datetime(2024, 6, 1))
    empty = spark.createDataFrame([], POINT)
    f = fixtures.files(spark, sf_dir).withColumns({"section": F.lit("all"), "source_file": F.col("rel_path"), "chunk_index": F.lit(0)})
    f = f.withColumn("id", identity.point_id(F.col("section"), F.col("source_file"), F.col("content_hash"), F.col("chunk_index")))
    index = lambda base: F.array(F.col("doc_id") % 10 + base, F.col("size") % 7 + 100, F.col("doc_id") % 10 + base)
    point = lambda indices: f.withColumn("indices", indices).select("doc_id", *[(F.col(c) if c in (*f.columns, "indices") else F.lit(None)).cast(empty.schema[c].dataType).alias(c) for c in empty.columns])
    store.upsert_points(point(index(0)).filter("doc_id % 3 <> 0").drop("doc_id"))
    store.upsert_points(point(index(1000)).filter("doc_id % 3 <> 1").drop("doc_id"))
    store.delete_points("all", f.filter("doc_id % 10 = 7").select("source_file"))
    return store.counts("all").filter("kind <> 'file'").select("kind", "term", "n")


def _wiki(spark: SparkSession, sf_dir: str, ingest: bool = True) -> tuple[Engine, str]:
    """An engine over a new folder whose section ``docs`` holds every document as a file, ingested. The folder is on a file system that all nodes share."""
    base = re.sub("^file:(//)?(?=/)", "", _scratch(spark))
    folder = f"{base}/wiki/docs"
    os.makedirs(folder)
    with open(f"{folder}/section.yaml", "w", encoding="utf-8") as f:
        f.write("description: all documents\n")

    def put(frames):
        for f in frames:
            for name, text in zip(f["rel_path"], f["text"]):
                with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as out:
                    out.write(text)
            yield f[["rel_path"]]

    fixtures.files(spark, sf_dir).select("rel_path", "text").mapInPandas(put, "rel_path string").count()
    engine = Engine(spark, Config(wiki_dir=f"{base}/wiki"), Store(spark, f"file://{base}/store", clock=lambda: datetime(2024, 6, 1)), HashEmbedder(16))
    if ingest:
        _ingest(engine)
    return engine, folder


def _ingest(engine: Engine) -> dict:
    engine.ingest("docs")
    if engine.runs["docs"]["status"] != "completed":
        raise RuntimeError(engine.runs["docs"]["error"])
    return engine.runs["docs"]["summary"]


def engine_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the interface answers over a section of all documents, case by case: refusals in their order, both gates and their effects, navigation, status, and the reset by other settings."""
    engine, folder = _wiki(spark, sf_dir, ingest=False)
    search = lambda mode, section="docs", **more: engine.search(section, QUERY, 10, mode, **more)

    def settings(chunk_size: int) -> None:
        with open(f"{folder}/section.yaml", "w", encoding="utf-8") as f:
            f.write(f"description: all documents\nchunk_size: {chunk_size}\n")

    out: dict[str, object] = {
        "search before an ingest": search("keyword")["error"], "files before an ingest": engine.list_files("docs")["error"], "chunks before an ingest": engine.get_chunks("docs", "doc_1.txt")["error"],
        "unknown mode": search("magic", "nowhere")["error"], "unknown section": search("keyword", "nowhere")["error"], "details of an unknown section": engine.section_details("nowhere")["error"],
        "sections": ", ".join(f"{s['section']}: {s['description']}" for s in engine.sections()),
    }
    summary = _ingest(engine)
    coverage, status = engine.section_details("docs")["coverage"], engine.status({"sections": ["docs"]})
    out |= {
        "first ingest": f"{summary['new']} new, reset {summary['reset']}", "coverage": f"{coverage['ingested']} of {coverage['on_disk']}, {coverage['total_chunks']} chunks",
        "files": len(engine.list_files("docs")["files"]), "semantic results": len(search("semantic")["results"]), "hybrid results": len(search("hybrid")["results"]),
        "status": f"{', '.join(status)}: {status['sections']['docs']['ingested']} ingested, {status['sections']['docs']['error']} in error", "status by key": ", ".join(engine.status({"health": True})),
    }
    with open(f"{folder}/late.txt", "w", encoding="utf-8") as f:
        f.write("Late.")
    out |= {"incomplete": search("keyword")["incomplete"]["summary"], "incomplete and allowed": "; ".join(search("keyword", allow_incomplete=True)["warnings"])}
    settings(400)
    out |= {"other settings, semantic": search("semantic")["error"], "other settings, keyword": "; ".join(search("keyword", allow_incomplete=True)["warnings"])}
    summary = _ingest(engine)
    out |= {"ingest after other settings": f"{summary['new']} new, reset {summary['reset']}", "search after it": "; ".join(search("keyword")["warnings"])}
    return spark.createDataFrame([(k, str(v)) for k, v in out.items()], "case string, answer string")


def _found(spark: SparkSession, engine: Engine) -> DataFrame:
    rows = engine.search("docs", QUERY, 10, "keyword")["results"]
    out = spark.createDataFrame([(r["source_file"], r["chunk_index"], r["page_number"], r["text"], r["score"]) for r in rows], "source_file string, chunk_index int, page_number int, text string, score double")
    return out.withColumn("score", F.round("score", 6))


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search through the engine: files discovered, parsed, chunked, embedded, stored and searched behind both gates."""
    return _found(spark, _wiki(spark, sf_dir)[0])


def engine_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from posting lists of the section's state."""
    engine, _ = _wiki(spark, sf_dir)
    engine.index("docs")
    return _found(spark, engine)


def engine_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after an ingest, changes on disk by doc_id mod 10 (1 deleted, 2 rewritten, 3 moved to a folder), and a pass of the daemon; with points that are searched."""
    engine, folder = _wiki(spark, sf_dir)
    os.makedirs(f"{folder}/moved")

    def change(frames):
        for f in frames:
            for name in f["rel_path"]:
                digit, path = name[-5:-4], f"{folder}/{name}"
                if digit == "1":
                    os.remove(path)
                elif digit == "2":
                    with open(path, "a", encoding="utf-8") as out:
                        out.write(" changed")
                elif digit == "3":
                    os.rename(path, f"{folder}/moved/{name}")
            yield f

    fixtures.files(spark, sf_dir).select("rel_path").mapInPandas(change, "rel_path string").count()
    engine.poll()
    live = engine.live_points("docs").groupBy(F.col("source_file").alias("rel_path")).agg(F.count("*").alias("searched"))
    rows = engine.store.files("docs").join(live, "rel_path", "left_outer")
    return rows.select("rel_path", "content_hash", "size", "status", "in_use", "total_chunks", "chunks_done", F.date_format("delete_after", "yyyy-MM-dd").alias("delete_after"), F.coalesce("searched", F.lit(0)).alias("searched"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        keyword_topk, semantic_topk, hybrid_rrf, sparse_tf, doc_freq_idf, query_batch_topk, semantic_batch_topk, estimate_tokens, sentence_pack, chunk_documents,
        chunk_conversations, structured_chunks, content_hash, exact_duplicates, point_ids, term_indices, sparse_vectors, classify_extension, size_cap_sniff,
        list_files, get_chunks, section_resolve, validity_gate, completeness_gate, completeness_verdicts, section_coverage, status_counts, ingest_dispatch,
        ingest_counters, daemon_diff, cheap_change, purge_expired, purge_totals, orphan_sections, repath_points, latest_state, live_points, store_transitions, store_points,
        engine_search, engine_lifecycle, keyword_index_topk, query_batch_index_topk, vector_index_topk, vector_index_recall, lifecycle_stream, store_counts, engine_index_search, engine_interface,
    )
}
