"""Sparse term vectors: term frequencies, document frequencies, inverse document frequencies."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import term_index, term_vectors
from tessera.functions.text import counted_terms, has_terms, terms


def _repeated(texts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose keys no other row has, and the others; none where a scan of the keys finds no others."""
    more = texts.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(*[F.col(k).alias(f"__{k}") for k in keys])
    if not more.take(1):
        return texts, None
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return texts.join(more, same, "left_anti"), texts.join(more, same, "left_semi")


def term_frequencies(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, term, tf): one row for each term of each text; texts of equal keys count as one.

    A text's terms are counted in its row, so a task holds the terms of one text, and nothing shuffles but rows whose keys are repeated.
    """
    once, more = _repeated(texts, keys)
    rows = lambda t: t.select(*keys, F.explode(counted_terms(F.col(text))).alias("t")).select(*keys, "t.term", "t.tf")
    return rows(once) if more is None else rows(once).unionByName(rows(more).groupBy(*keys, "term").agg(F.sum("tf").alias("tf")))


def document_frequencies(tf: DataFrame, by: str = "term") -> DataFrame:
    """(by, df); a text counts once however many of its terms share an index."""
    return tf.groupBy(by).agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - n + 0.5) / (n + 0.5)): the Robertson-Sparck Jones weight, never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def indexed(tf: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, idx, tf): terms by their 31-bit index, those of one index added up. Each distinct term is hashed once, then joined."""
    index = tf.select("term").distinct().withColumn("idx", term_index("term"))
    return tf.join(index, "term").groupBy(*keys, "idx").agg(F.sum("tf").alias("tf"))


def sparse_vectors(tf: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, indices, values): in the order of the terms, as parallel arrays."""
    index = tf.select("term").distinct().withColumn("idx", term_index("term"))
    packed = tf.join(index, "term").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "idx", "tf"))).alias("v"))
    return packed.select(*keys, F.col("v.idx").alias("indices"), F.transform("v.tf", lambda x: x.cast("double")).alias("values"))


def text_vectors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``sparse_vectors`` of ``term_frequencies`` of texts: in the row, but for rows whose keys are repeated."""
    once, more = _repeated(texts, keys)
    rows = with_vectors(once.filter(has_terms(F.col(text))), text).select(*keys, "indices", "values")
    return rows if more is None else rows.unionByName(sparse_vectors(term_frequencies(more, keys, text), keys))


def with_vectors(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with indices and values, as of ``sparse_vectors`` over each row's text: in the row, without a shuffle. Null where there are no terms."""
    out = texts.withColumn("__vector", term_vectors(terms(F.col(text))))
    return out.withColumns({c: F.col(f"__vector.{c}") for c in ("indices", "values")}).drop("__vector")
