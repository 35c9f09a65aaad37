"""Incremental ingestion of a stream of files: each micro-batch is parsed, chunked and stored by foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.identity import point_id
from tessera.operators import chunking, sparse
from tessera.plans.store import Store
from tessera.sources.embedding import Embedder, embed_udf

#: A row for each version of a file.
FILES = "section string, rel_path string, text string"


def points_of(batch: DataFrame, embedder: Embedder, model: str, size: int, overlap: int, count: Callable[[str], int] = chunking.estimate_tokens) -> DataFrame:
    """The points of files (section, rel_path, text)."""
    f = batch.select("section", F.col("rel_path").alias("source_file"), F.sha2("text", 256).alias("content_hash"), F.array(F.struct("text", F.lit(0).alias("page_number"))).alias("pages"))
    c = chunking.chunk(f, size, overlap, count)
    c = c.withColumn("id", point_id(F.col("section"), F.col("source_file"), F.col("content_hash"), F.col("chunk_index"))).withColumn("e", embed_udf(embedder, model)("text"))
    # a stream's batch runs again as a whole, so an error ends it
    c = c.withColumn("dense", F.expr("CASE WHEN e.error IS NULL THEN e.vector ELSE raise_error(e.error) END"))
    return sparse.with_vectors(c)


def ingest_batch(store: Store, batch: DataFrame, embedder: Embedder, model: str, size: int, overlap: int) -> None:
    """Points first, then one event for each file. Ids follow from content, so a batch that runs again after a crash changes nothing.

    Only the sections of the batch are read and written, and only its own chunks are counted.
    """
    with store.work() as keep:
        points = keep(points_of(batch, embedder, model, size, overlap))
        store.upsert_points(points)
        n = points.groupBy("section", F.col("source_file").alias("rel_path"), "content_hash").agg(F.count("*").cast("int").alias("total_chunks"))
        files = batch.select("section", "rel_path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
        null = F.lit(None)
        rows = files.join(n, ["section", "rel_path", "content_hash"], "left_outer").fillna(0, ["total_chunks"])
        rows = rows.withColumns({"mtime": null.cast("timestamp"), "chunks_done": F.col("total_chunks"), "in_use": F.lit(True), "status": F.lit("ingested"), "error_reason": null.cast("string"), "delete_after": null.cast("timestamp")})
        store.append(rows)


def start(spark: SparkSession, source: str, store: Store, embedder: Embedder, checkpoint: str, model: str = "nomic-embed-text", size: int = 512, overlap: int = 51, once: bool = False) -> StreamingQuery:
    """Follow a folder of Parquet files of FILES rows. The checkpoint remembers what has been read; ``once`` takes what is there and ends."""
    stream = spark.readStream.schema(FILES).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_batch(store, batch, embedder, model, size, overlap))
    return (writer.trigger(availableNow=True) if once else writer).start()
