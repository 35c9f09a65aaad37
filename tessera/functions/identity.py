"""Content hashes and deterministic ids."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

#: Fixed value: the namespace of point ids.
NAMESPACE = "435d3986-fa80-54b7-9476-79b9f05633c6"
#: Fixed value: term indices are below it.
INDEX_SPACE = 2**31


def content_hash(content: Column) -> Column:
    """SHA-256, in hex, of text (as UTF-8) or bytes."""
    return F.sha2(content, 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID: SHA-1 of the namespace's bytes and the name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(section: Column, source_file: Column, hash_: Column, chunk_index: Column) -> Column:
    """The id of a chunk: it follows from where the chunk is and what its file holds, so that a replay writes the same ids."""
    return uuid5(NAMESPACE, F.concat_ws("\0", section, source_file, hash_, chunk_index.cast("string")))


def index_of(term: str) -> int:
    """The 31-bit index of a term, the same in every process: four BLAKE2b bytes, big-endian."""
    return int.from_bytes(blake2b(term.encode(), digest_size=4).digest(), "big") % INDEX_SPACE


#: ``index_of`` with the last terms of a worker kept: frequent ones are hashed once.
_index_of = lru_cache(100_000)(index_of)


@F.arrow_udf(StructType().add("indices", ArrayType(LongType())).add("values", ArrayType(DoubleType())))
def term_vectors(terms: pa.Array) -> pa.Array:
    """Indices and counts of each array's different terms, in the order of the terms; null for none. Terms are numbered once a batch, and counted as numbers."""
    from tessera.functions import identity  # the worker's own cache, not a copy of it

    flat = terms.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    rank, size = np.empty(len(words), np.int64), max(1, len(words))
    rank[order] = np.arange(len(words))
    row = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
    key, n = np.unique(row * size + rank[flat.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    index = np.array([identity._index_of(words[i]) for i in order], np.int64)
    each = np.bincount(key // size, minlength=len(terms))
    ends, none = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(each == 0)
    columns = [pa.ListArray.from_arrays(ends, pa.array(x), mask=none) for x in (index[key % size], n.astype(np.float64))]
    return pa.StructArray.from_arrays(columns, ["indices", "values"])


@F.pandas_udf(LongType())
def term_index(terms: pd.Series) -> pd.Series:
    """Indices of terms; apply it to distinct terms, and join."""
    return terms.map(index_of, na_action="ignore")
