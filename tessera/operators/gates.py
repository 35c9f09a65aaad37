"""Gates before a search: do stored vectors fit the configuration, and is all that is on disk indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = ("skipped_size", "skipped_binary")
CATEGORIES = ("pending", "changed", "in_progress", "stale")


def validity(sections: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(section, valid, reason): configured against stored model, chunk size and overlap; a section without fingerprint is valid."""
    c, f = sections.alias("c"), fingerprints.alias("f")
    both = c.join(f, F.col("c.section") == F.col("f.section"), "left_outer")
    differ = lambda k: F.when(F.col("f.section").isNotNull() & ~F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")), F.concat(F.lit(f"{k} "), F.col(f"f.{k}").cast("string"), F.lit(" -> "), F.col(f"c.{k}").cast("string")))
    reason = F.concat_ws("; ", *[differ(k) for k in ("embed_model", "chunk_size", "chunk_overlap")])
    return both.select("c.section", (reason == "").alias("valid"), F.nullif(reason, F.lit("")).alias("reason"))


def completeness(disk: DataFrame, state: DataFrame) -> DataFrame:
    """(section, rel_path, category): pending, changed, in_progress, stale, or ok, for each file on disk or in state that counts.

    On disk: no row is pending; skipped rows don't count; ingested rows are ok or, out of use, changed; others but ingesting ones are pending. In
    state: ingesting is in_progress wherever the file is; ingested and in use but off disk is stale.
    """
    d = disk.select("section", "rel_path", F.lit(True).alias("on_disk"))
    both = d.join(state.select("section", "rel_path", "status", "in_use"), ["section", "rel_path"], "full_outer")
    done = F.col("status") == "ingested"
    category = (
        F.when(F.col("status").isin(*SKIPPED), None)
        .when(F.col("status") == "ingesting", "in_progress")
        .when(F.col("on_disk") & done & F.col("in_use"), "ok")
        .when(F.col("on_disk") & done, "changed")
        .when(F.col("on_disk"), "pending")
        .when(done & F.col("in_use"), "stale")
    )
    return both.select("section", "rel_path", category.alias("category")).filter("category IS NOT NULL")


def verdicts(files: DataFrame, sample: int = 10) -> DataFrame:
    """One row per section from completeness rows: complete, a summary, and each category's count and first paths, capped with a note.

    All files are counted; paths are ranked, and only the first ``sample`` of a section and category, which each task cuts before the shuffle, are gathered.
    """
    counts = files.groupBy("section").agg(*[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES])
    rank = F.row_number().over(Window.partitionBy("section", "category").orderBy("rel_path"))
    some = files.filter(F.col("category").isin(*CATEGORIES)).withColumn("__rank", rank).filter(F.col("__rank") <= sample)
    lists = some.groupBy("section").agg(*[F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("rel_path")))).alias(c) for c in CATEGORIES])
    out = counts.join(lists, "section", "left_outer")

    def first(c: str) -> Column:
        paths, rest = F.coalesce(c, F.array().cast("array<string>")), F.col(f"n_{c}") - sample
        return F.when(rest > 0, F.array_append(paths, F.concat(F.lit("...(+"), rest.cast("string"), F.lit(" more)")))).otherwise(paths).alias(c)

    summary = F.concat_ws(", ", *[F.when(F.col(f"n_{c}") > 0, F.concat(F.col(f"n_{c}").cast("string"), F.lit(f" {c}"))) for c in CATEGORIES])
    out = out.select("section", *[f"n_{c}" for c in CATEGORIES], *[first(c) for c in CATEGORIES])
    return out.withColumn("complete", summary == "").withColumn("summary", F.when(summary == "", "complete").otherwise(summary))


def coverage(disk: DataFrame, state: DataFrame) -> DataFrame:
    """One row per section: files on disk, ingested, pending, changed, in progress, marked for deletion, and chunks in use."""
    c = completeness(disk, state).groupBy("section").agg(*[F.count_if(F.col("category") == k).alias(k) for k in ("pending", "changed", "in_progress")])
    live = (F.col("status") == "ingested") & F.col("in_use")
    s = state.groupBy("section").agg(F.count_if(live).alias("ingested"), F.count_if(~F.col("in_use") & F.col("delete_after").isNotNull()).alias("marked_for_deletion"), F.sum(F.when(live, F.col("total_chunks")).otherwise(0)).alias("total_chunks"))
    d = disk.groupBy("section").agg(F.count("*").alias("on_disk"))
    out = d.join(s, "section", "full_outer").join(c, "section", "full_outer")
    names = ("on_disk", "ingested", "pending", "changed", "in_progress", "marked_for_deletion", "total_chunks")
    return out.select("section", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
