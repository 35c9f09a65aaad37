"""Files of a section as a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.functions.files import PEEK, classify, extension, skip_reason
from tessera.session import scratch_table

from .rules import ALLOW, ALLOW_FILE, IGNORE, IGNORE_FILE, Ignore, extensions_of, lines_of

LISTED = "rel_path string, path string, directory boolean, size long, mtime double, walk_order string, error string"
#: Directories that a task lists, or so.
DIRECTORIES_A_TASK = 64
#: Rows of a listing that are held at once, however large a directory is; and files that a task opens, or so.
LISTED_AT_ONCE, FILES_A_TASK = 10_000, 1_000


def ignore_of(directory: str | Path) -> Ignore:
    """Shipped patterns, then the section's own."""
    own = Path(directory) / IGNORE_FILE
    return Ignore([*IGNORE, *(lines_of(own.read_text(encoding="utf-8")) if own.is_file() else [])])


def allow_of(directory: str | Path) -> set[str]:
    own = Path(directory) / ALLOW_FILE
    return {*ALLOW, *(extensions_of(own.read_text(encoding="utf-8")) if own.is_file() else ())}


def _children(root: str, rel: str, order: str, ignore: Ignore) -> Iterator[tuple]:
    """What a directory holds and isn't ignored, as LISTED rows. ``order`` puts a directory's files before its subdirectories, each by name; a directory that can't be listed is empty, and links to directories aren't followed."""
    try:
        entries = os.scandir(os.path.join(root, rel))
    except OSError:
        return
    for e in entries:
        name, path, error = e.name, f"{rel}/{e.name}" if rel else e.name, None
        try:
            name.encode()
        except UnicodeEncodeError:
            name, path, error = (x.encode("utf-8", "replace").decode() for x in (name, path, "unreadable:the name is not UTF-8"))
        directory = e.is_dir()
        if ignore.matches(path, directory) or (directory and (e.is_symlink() or error)):
            continue
        if directory:
            yield path, None, True, None, None, f"{order}1{name}\0", None
            continue
        try:
            stat = e.stat()
            yield path, os.path.join(root, path), False, stat.st_size, stat.st_mtime, f"{order}0{name}", error
        except OSError as x:
            yield path, os.path.join(root, path), False, None, None, f"{order}0{name}", error or f"unreadable:{x.strerror}"


def list_tree(spark: SparkSession, directory: str | Path, ignore: Ignore) -> DataFrame:
    """The files of a tree as LISTED rows, listed by executors (whose nodes share the folder): a level of directories at a time, each level a table of the next ones and of files.

    Ignored directories aren't entered. The driver sees only how many directories a level has; names stay in tables, and ``walk_order`` sorts as a walk would.
    """
    root, columns = str(directory), [c.split()[0] for c in LISTED.split(", ")]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = (row for rel, order in zip(f["rel_path"], f["walk_order"]) for row in _children(root, rel, order, ignore))
            while part := list(islice(rows, LISTED_AT_ONCE)):
                yield pd.DataFrame(part, columns=columns).astype({"size": "Int64", "directory": bool})

    level, files, n = spark.createDataFrame([("", "")], "rel_path string, walk_order string"), None, 1
    while n:
        found = scratch_table(level.repartition(-(-n // DIRECTORIES_A_TASK)).mapInPandas(scan, LISTED), "listing")
        files = found.filter("NOT directory") if files is None else files.unionByName(found.filter("NOT directory"))
        level = found.filter("directory").select("rel_path", "walk_order")
        n = level.count()
    return files.drop("directory")


def read_bytes(paths: pd.Series, limit: int | None = None) -> pd.Series:
    def one(path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read(limit) if limit else f.read()
        except OSError:
            return None

    return paths.map(one)


@F.pandas_udf(BinaryType())
def head(paths: pd.Series) -> pd.Series:
    """The first bytes of files; null where unreadable."""
    return read_bytes(paths, PEEK)


#: What a file holds may change between two reads: so a filter of what was read is no second read, nor a second evaluation of the columns that it hangs on.
head = head.asNondeterministic()


@F.pandas_udf(BinaryType())
def content(paths: pd.Series) -> pd.Series:
    """Whole files; null where unreadable."""
    return read_bytes(paths)


def discover_files(spark: SparkSession, directory: str | Path, cap_text: int = 10 << 20, cap_other: int = 1 << 20) -> DataFrame:
    """rel_path, path, size, mtime, walk_order, file_class, skip_reason (null: take it) of what isn't ignored.

    Names are listed and contents read on executors (whose nodes share the section's folder), contents only of files within their cap. Spark's binaryFile source isn't used: it hides names that begin with a dot or underscore.
    """
    directory = Path(directory)
    listed = list_tree(spark, directory, ignore_of(directory))
    # one task lists a directory; opening its files is dealt to as many as there are files for
    listed = listed.repartition(max(1, -(-listed.count() // FILES_A_TASK)))
    kind = classify(extension(F.col("rel_path")), allow_of(directory))
    f = listed.withColumn("file_class", kind).withColumn("mtime", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long")))
    cap = F.when(F.col("file_class") == "known_text", cap_text).otherwise(cap_other)
    sniffed = F.when((F.col("file_class") != "known_binary") & (F.col("size") <= cap), head("path"))
    f = f.withColumn("__head", sniffed)
    reason = F.coalesce("error", skip_reason(F.col("file_class"), F.col("size"), F.col("__head"), cap_text, cap_other))
    return f.withColumn("skip_reason", reason).drop("__head", "error")
