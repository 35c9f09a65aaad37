"""Document fingerprints: invertible Bloom lookup tables of paragraph digests."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import blake2b
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table

#: Paragraphs are lines, cut further at sentence ends and, where long, at word ends picked by content, so that they resync after an edit.
_LINES = re.compile(r"[^\n]*?[.!?](?=\s)|[^\n]+")
_WORDS = re.compile(r"\s*\S{1,64}")
#: Texts of fewer characters also give short paragraphs, so that an edit of a short text leaves some of them whole.
SHORT_TEXT = 1024
#: Cells of the smallest table; each retry has twice as many.
FIRST_CELLS = 24
_PLACES = 3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_STEPS = np.arange(1, 1 + _PLACES, dtype=np.uint64) * _M2


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def paragraphs(text: str) -> list[str]:
    """The text's paragraphs, about 8 words each."""
    out: list[str] = []
    for line in _LINES.findall(text):
        if len(line) <= 96:
            out.append(line)
            continue
        held, size = [], 0
        for word in _WORDS.findall(line) or [line]:
            held.append(word)
            size += len(word)
            if size >= 160 or size >= 32 and sum(map(ord, word)) % 6 == 0:
                out.append("".join(held))
                held, size = [], 0
        if held:
            out.append("".join(held))
    return out


def short_paragraphs(text: str) -> list[str]:
    """About a word each; of texts with few words, two characters each. Only short texts have them."""
    if len(text) >= SHORT_TEXT:
        return []
    words = re.findall(r"\S{1,8}", text)
    return words if len(words) >= 8 else [text[i : i + 2] for i in range(len(text))]


def digests(parts: list[str]) -> np.ndarray:
    """Distinct 64-bit digests of paragraphs, whose low 12 bits hold the length, so that recovered digests also tell how much text differs. The k-th time that a paragraph comes counts as another one."""
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        k = seen[p] = seen.get(p, -1) + 1
        out.append(_digest(b"%d:" % k + p.encode("utf-8", "surrogatepass")) << 12 & 0xFFFFFFFFFFFFFFFF | min(len(p), 4095))
    return np.unique(np.array(out, np.uint64))


def weight(keys: np.ndarray) -> int:
    """Characters of the paragraphs."""
    return int((keys & np.uint64(4095)).sum())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Sketches:
    """Invertible Bloom lookup tables of many texts side by side: cells with a count, the xor of keys, and the xor of key checks.

    Table t has three parts of parts[t] cells, and a key takes one cell in each. Tables of one size subtract cell by cell, which is the same as adding one
    side's keys and taking off the other's. Peeling cells of one key then recovers the keys on which the two sets differ; it runs over all tables at once.
    """

    def __init__(self, parts: np.ndarray):
        self.parts = parts.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(parts * _PLACES)]).astype(np.int64)
        n = int(self.starts[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def toggle(self, table: np.ndarray, keys: np.ndarray, sign) -> None:
        part, start, check = self.parts[table], self.starts[table], _mix(keys)
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        for i in range(_PLACES):
            at = (_mix(keys + _STEPS[i]) % part).astype(np.int64) + start + i * part.astype(np.int64)
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each table: whether nothing is left in it, and the weights of the keys that only the first and only the second side has."""
        n = len(self.parts)
        owner = np.repeat(np.arange(n), np.diff(self.starts))
        first, second, found = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        look = np.arange(len(self.count))  # cells that may have come to hold one key
        while len(look):
            c = self.count[look]
            look = look[(c == 1) | (c == -1)]
            pure = look[self.checks[look] == _mix(self.keys[look])]
            if not len(pure):
                break
            order = np.lexsort((self.keys[pure], owner[pure]))
            pure = pure[order]
            new = np.ones(len(pure), bool)
            new[1:] = (self.keys[pure][1:] != self.keys[pure][:-1]) | (owner[pure][1:] != owner[pure][:-1])
            pure = pure[new]
            keys, signs, table = self.keys[pure].copy(), self.count[pure].copy(), owner[pure]
            size = (keys & np.uint64(4095)).astype(float)
            first += np.bincount(table, np.where(signs > 0, size, 0), n)
            second += np.bincount(table, np.where(signs < 0, size, 0), n)
            found += np.bincount(table, minlength=n)
            keep = found[table] <= 4 * self.parts[table].astype(np.int64)  # a false key could otherwise come and go for ever
            table, keys, signs = table[keep], keys[keep], signs[keep]
            self.toggle(table, keys, -signs)
            part = self.parts[table]
            look = np.unique(np.concatenate([(_mix(keys + _STEPS[i]) % part).astype(np.int64) + self.starts[table] + i * part.astype(np.int64) for i in range(_PLACES)]))
        left = np.bincount(owner, (self.count != 0) | (self.keys != 0), n)
        return left == 0, first, second


class Fingerprint:
    """Digests of a text's paragraphs, and for a short text of its short ones."""

    def __init__(self, text: str):
        self.long, self.short = digests(paragraphs(text)), digests(short_paragraphs(text))

    @property
    def main(self) -> np.ndarray:
        return self.short if len(self.short) else self.long


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Set number and key of all keys."""
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.empty(0, np.uint64)])


def to_text(prints: list[Fingerprint]) -> list[str]:
    """Numbers of digests, characters, and the smallest table: 20 bytes a cell in base64. Equal texts give equal strings."""
    t = Sketches(np.full(len(prints), FIRST_CELLS // _PLACES))
    t.toggle(*_flat([p.main for p in prints]), 1)
    rows = zip(prints, t.count.astype(np.int32).reshape(-1, FIRST_CELLS), t.keys.reshape(-1, FIRST_CELLS), t.checks.reshape(-1, FIRST_CELLS))
    return [f"{len(p.long)}:{len(p.short)}:{weight(p.long)}:" + base64.b64encode(c.tobytes() + k.tobytes() + x.tobytes()).decode() for p, c, k, x in rows]


def likenesses(pairs: list[tuple[Fingerprint, Fingerprint]]) -> list[float]:
    """Shared characters in proportion to all of either (Dice), from the digests that peeling recovers: of the short paragraphs where both texts have
    them, else of the long ones. Two empty texts have likeness 1.

    All pairs begin with the smallest table. Where the difference is too large for it peeling fails, and the pair is tried again with a table twice
    as large at least, until it succeeds. As each key that differs adds 1 or -1 to one cell of each part, the squared counts tell about how large.
    """
    sides = [(a.short, b.short) if len(a.short) and len(b.short) else (a.long, b.long) for a, b in pairs]
    out = [0.0 if len(a) or len(b) else 1.0 for a, b in sides]
    todo = np.array([i for i, (a, b) in enumerate(sides) if len(a) and len(b)], np.int64)
    parts = np.full(len(todo), FIRST_CELLS // _PLACES)
    while len(todo):
        t = Sketches(parts)
        t.toggle(*_flat([sides[i][0] for i in todo]), 1)
        t.toggle(*_flat([sides[i][1] for i in todo]), -1)
        n, m = (np.array([len(sides[i][k]) for i in todo]) for k in (0, 1))
        owner = np.repeat(np.arange(len(todo)), parts * _PLACES)
        differ = np.bincount(owner, t.count.astype(float) ** 2, len(todo)) / _PLACES - (n - m) ** 2 / parts
        ok, first, second = t.peel()
        for j in np.flatnonzero(ok):
            a, b = (weight(x) for x in sides[todo[j]])
            if a - first[j] == b - second[j] >= 0:
                out[todo[j]] = float(2 * (a - first[j]) / (a + b)) if a + b else 1.0
            else:
                ok[j] = False  # a false key
        # at least twice as large, and large enough for what the counts tell
        parts = np.maximum(2 * parts, np.ceil(1.6 * np.minimum(differ, n + m) / _PLACES).astype(np.int64))[~ok]
        todo = todo[~ok]
    return out


def _block_of(doc_id: Column, cuts: list) -> Column:
    """How many cuts an id has reached; 0 for null. Cuts are searched in groups of about the square root of their number, so many cost little."""
    if not cuts:
        return F.lit(0)
    size = isqrt(len(cuts)) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    literal = lambda x: F.array(*map(F.lit, x))
    reached = lambda cuts: F.size(F.filter(cuts, lambda c: c <= doc_id))
    group = reached(literal([g[0] for g in groups]))
    within = reached(F.element_at(F.array(*map(literal, groups)), F.greatest(group, F.lit(1))))
    return F.when(doc_id.isNull() | (group == 0), 0).otherwise((group - 1) * size + within).cast("int")


def next_texts(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """Rows (block, doc_id, text, extra) such that in each block, by id, each row but extras is followed by its next document.

    Blocks are ranges of ids between quantiles. The first id of each block is also sent, as an extra, to the end of the block before it (of the first
    block: to the last), so a block is read as a stream and nothing needs a window over the whole table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / partitions for i in range(1, partitions)], max(10_000, 10 * partitions)).alias("q")).first()["q"] if partitions > 1 else None
    block = _block_of(F.col("doc_id"), sorted(set(cuts or [])))  # at most `partitions` numbers
    heads = table(rows.select(block.alias("block"), "doc_id").groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m")), "print-heads")
    every = Window.orderBy("block")  # at most `partitions` rows
    heads = heads.select(F.col("m.doc_id").alias("head"), F.coalesce(F.lag("block").over(every), F.max("block").over(Window.partitionBy(F.lit(1)))).alias("to"))
    rows = rows.withColumn("block", block).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left_outer")
    here = F.struct(F.col("block").alias("block"), F.lit(False).alias("extra"))
    there = F.struct(F.col("to").cast("int").alias("block"), F.lit(True).alias("extra"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return rows.select("at.block", "doc_id", "text", "at.extra")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is the text with its last floor(n/4) code points replaced by the first as many (or all) of the next document
    by id; after the last comes the first. Null ids come first, texts of one id by text. Null texts count as empty, and a lone document follows itself.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = next_texts(docs, id_col, text_col, partitions)
    rows = rows.repartitionById(partitions, "block").sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next document has not come yet
        for f in frames:
            rows = []
            for doc_id, text, extra in zip(f["doc_id"], f["text"], f["extra"]):
                new = (doc_id, text or "", Fingerprint(text or ""))
                if held is not None:
                    rows.append((held, new))
                held = None if extra else new
            if rows:
                yield _compared(rows)

    # ids pass pandas as text: a column of numbers with nulls would become floating point
    kind = docs.schema[id_col].dataType
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _compared(rows: list[tuple[tuple, tuple]]) -> pd.DataFrame:
    """Output rows for pairs of (id, text, fingerprint) and the next one."""
    edited = [text[: len(text) - len(text) // 4] + after[: len(text) // 4] for (_, text, _), (_, after, _) in rows]
    own, following = [p for (_, _, p), _ in rows], [p for _, (_, _, p) in rows]
    others = [p if e == text else Fingerprint(e) for ((_, text, p), _), e in zip(rows, edited)]
    near = likenesses([*zip(own, others), *zip(own, following)])
    return pd.DataFrame({
        "doc_id": [doc_id for (doc_id, _, _), _ in rows], "n_chars": [len(text) for (_, text, _), _ in rows], "edited": edited, "fingerprint": to_text(own),
        "edited_fingerprint": to_text(others), "near_edited": near[: len(rows)], "near_next": near[len(rows) :],
    })
