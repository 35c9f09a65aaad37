"""Classes and skip reasons of files as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.rules import ALLOW, BINARY_EXTENSIONS

#: Bytes in which a NUL makes a file binary.
PEEK = 8192


def extension(path: Column) -> Column:
    """The last suffix of a path's name, lower case; empty for names like ``.env``."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1))


def classify(ext: Column, allow: frozenset[str] | set[str] = frozenset(ALLOW)) -> Column:
    """known_binary, known_text or other."""
    ext = F.lower(ext)
    return F.when(ext.isin(*BINARY_EXTENSIONS), "known_binary").when(ext.isin(*sorted(allow)), "known_text").otherwise("other")


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes; unreadable (null) content counts as binary."""
    return F.coalesce(F.contains(F.substring(content, 1, PEEK), F.unhex(F.lit("00"))), F.lit(True))


def skip_reason(file_class: Column, size: Column, content: Column, cap_text: int, cap_other: int) -> Column:
    """Null for a file to take; ``too_large:size>cap`` before ``binary``. Known binary formats have neither check."""
    cap = F.when(file_class == "known_text", cap_text).otherwise(cap_other)
    large = F.concat(F.lit("too_large:"), size.cast("string"), F.lit(">"), cap.cast("string"))
    return F.when(file_class == "known_binary", F.lit(None).cast("string")).when(size > cap, large).when(looks_binary(content), "binary")
