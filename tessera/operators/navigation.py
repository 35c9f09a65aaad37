"""Looking around in what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_files(points: DataFrame) -> DataFrame:
    """(source_file, total_chunks, max_page) of points in use, by file."""
    return points.filter("in_use").groupBy("source_file").agg(F.count("*").alias("total_chunks"), F.max("page_number").alias("max_page")).orderBy("source_file")


def get_chunks(points: DataFrame, source_file: str, start: int = 0, count: int = 10) -> DataFrame:
    """Chunks start to start + count - 1 of a file, in use; none for a count of 0 or less."""
    inside = (F.col("chunk_index") >= start) & (F.col("chunk_index") < start + max(0, count))
    return points.filter(F.col("in_use") & (F.col("source_file") == source_file) & inside).select("text", "source_file", "page_number", "chunk_index").orderBy("chunk_index")
