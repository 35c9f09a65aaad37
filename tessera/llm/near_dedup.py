"""MinHash near-dedup: banded candidates, sequential Bayesian pruning of signatures, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, keyed, small_batches, table, without, words_of
from .components import components

#: 32 bands of 4 values: at similarity 0.8, all bands of a pair differ with probability (1 - 0.8 ** 4) ** 32, about 5e-8.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: Signature values compared in one step of the sequential test.
STEP = 16
#: Members of a block, where members of a bucket are compared with each other.
BLOCK = 256

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, the whole sequence as one; of none, empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of HASHES multiply-add hashes over the set, its upper 32 bits."""
    out = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        out = np.minimum(out, (hashes[at : at + 2048, None] * _MUL + _ADD).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches of n at which P(similarity >= threshold | matches), from a uniform prior, is at least ``miss``.

    The posterior is Beta(m + 1, n - m + 1), whose mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no step of the sequential test prunes."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(bounds):
        s = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (a[left, s] == b[left, s]).sum(1, dtype=np.int32)
        ok = matches >= least
        left, matches = left[ok], matches[ok]
    return left


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls, sig): cls is a 128-bit hash of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sig = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k)
                n.append(len(s))
                cls.append(class_of(s))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "cls", "sig"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, cls binary, sig binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(used: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, members): the full sets of some classes, from the text of each one's first document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), k) for t in batch.column(1)]
            own = [class_of(s) for s in found]
            ok = pa.array([c == x for c, x in zip(own, batch.column(0).to_pylist())])  # ids that repeat may have other texts
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), pa.array([s.tobytes() for s in found], pa.binary()).filter(ok)], ["cls", "members"])

    first = used.join(classes.select("cls", "first_id"), "cls")
    texts = docs.join(first, docs["doc_id"].eqNullSafe(first["first_id"])).select("cls", "text")
    return texts.mapInArrow(sets, "cls binary, members binary")


def class_of(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, bounds: list[int]) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                yield f.iloc[survivors(a, b, bounds)][["a", "b"]]

    left = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("cls").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    like = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    like = table(like.select("a", "b", "sa", "sb").mapInPandas(prune, "a binary, b binary"), "near-like")

    used = like.select(F.col("a").alias("cls")).union(like.select("b")).distinct()
    members = _sets(used, classes, docs, k)

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(f["ma"], f["mb"])]
            yield f.loc[keep, ["a", "b"]]

    full = like.join(members.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a").join(members.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b")
    return table(full.select("a", "b", "ma", "mb").mapInPandas(exact, "a binary, b binary").distinct(), "near-edges")


def _stars(members: DataFrame) -> DataFrame:
    """One pair (a, b) for each member of a bucket with its hub: the member that shares most buckets with most others."""
    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    rows = members.join(degree, "cls")
    hubs = rows.groupBy("key").agg(F.max(F.struct("degree", F.col("cls").alias("hub"))).alias("h")).select("key", F.col("h.hub").alias("hub"))
    pairs = members.join(hubs, "key").filter("cls <> hub")
    return pairs.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()


def _rest(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int, bounds: list[int]) -> DataFrame:
    """More edges (a, b), between bucket members that are still in different components: enough to join all that link.

    In a bucket, only members outside its most common component need comparing, with all members. Buckets with the same most common component have much the
    same members, so they are taken together, and each member comes once. Both sides are dealt in blocks of about BLOCK members, and a task compares a block with
    a block: signatures first, then full sets, and no pair whose components the task has already joined. So no bucket is gathered
    whole, and a task's rows are at most the components that it joins.
    """
    placed = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left_outer").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = groups.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    rows = table(placed.join(main.select("key", F.col("m.root").alias("main")), "key").groupBy("main", "cls").agg(F.first("root").alias("root")), "near-rest")
    sizes = rows.groupBy("main").agg(F.count("*").alias("size"), F.count_if(F.col("root") != F.col("main")).alias("others"))
    full = classes.select("cls", "sig").join(_sets(rows.select("cls").distinct(), classes, docs, k), "cls")
    full = rows.join(sizes, "main").join(full, "cls")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    of = lambda n: F.pmod(F.xxhash64("cls"), blocks(n)).cast("int")
    kept = ["main", "cls", "root", "sig", "members"]
    here = F.transform(F.sequence(F.lit(0), blocks("size") - 1), lambda j: F.struct(of("others").alias("i"), j.alias("j"), F.lit(True).alias("first")))
    there = F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda i: F.struct(i.alias("i"), of("size").alias("j"), F.lit(False).alias("first")))
    dealt = full.withColumn("at", F.explode(F.when(F.col("root") != F.col("main"), F.concat(here, there)).otherwise(there))).select(*kept, "at.*")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, HASHES)
        ids, sets = f["cls"].to_numpy(), [np.frombuffer(m, np.uint64) for m in f["members"]]
        names = {r: i for i, r in enumerate(dict.fromkeys(f["root"]))}
        group = np.array([names[r] for r in f["root"]])  # components so far, joined as links are found
        own, other = np.flatnonzero(f["first"]), np.flatnonzero(~f["first"])
        edges = []
        for x in own:
            y = other[group[other] != group[x]]
            for z in y[survivors(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], bounds)]:
                if group[z] != group[x] and linked(sets[x], sets[z], percent):
                    edges.append((ids[x], ids[z]))
                    group[group == group[z]] = group[x]
        return pd.DataFrame(edges, columns=["a", "b"])

    return table(dealt.groupBy("main", "i", "j").applyInPandas(compare, "a binary, b binary").distinct(), "near-more")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents link if the Jaccard similarity of their sets of k-word shingles is at least percent / 100; a component's id is its smallest document id.
    Rows with equal sets form a class, and everything after works on classes. Candidates share a band of their signatures. Each bucket is first
    compared with its hub, which joins most of it; then members that are still in different components are compared with each other. Either way a sequential test
    compares signatures STEP values at a time, and drops a pair once P(similarity >= threshold | matches so far) < ``miss``; survivors are
    verified on their full sets. No bucket or candidate is capped.

    Null and empty texts have no shingles and link with nothing. Rows that repeat an id have the same component if their sets link, else each its own
    row; ids are compared as they are, and null counts as smaller than any. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    bounds = least_matches(percent / 100, miss)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profiles = table(_profiles(docs, k), "near-profiles")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("id")))
    classes = profiles.filter("cls IS NOT NULL").groupBy("cls").agg(first.alias("f"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = table(classes.select("cls", F.col("f.id").alias("first_id"), "n", "sig"), "near-classes")
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> shiftleft(xxhash64(b, substring(sig, {4 * BAND_ROWS} * b + 1, {4 * BAND_ROWS})), 5) + b)")
    banded = classes.select("cls", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = table(banded.join(shared, "key"), "near-members")
    edges = _verified(_stars(members), classes, docs, k, percent, bounds)
    roots = components(edges)
    more = _rest(members, classes, roots, docs, k, percent, bounds)
    if more.limit(1).take(1):
        roots = components(edges.unionByName(more))
    named = classes.select("cls", "first_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left_outer").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNotNull().alias("k"), F.col("first_id").alias("id"))).alias("f"))
    named = named.join(least, "root").select("cls", F.col("f.id").alias("component"), F.lit(True).alias("named"))
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("doc_id"))
    out = profiles.select("doc_id", "n", "cls").join(named, "cls", "left_outer")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_near(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component.

    Rows are told apart by id and text, so null and repeated ids lose no text; of rows that repeat both, one stays.
    """
    return without(docs, table(near_dedup(keyed(docs, id_col, text_col), k, percent).filter("not kept").select("doc_id").distinct(), "near-dropped"), id_col, text_col)
