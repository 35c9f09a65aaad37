"""Secret scans: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log10

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Base kinds in the order in which equal starts are listed, with (pattern, group, least length of the group).
BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: The same hex runs, without the short ones: a run of 32 or more is always matched from its start.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: A word that announces a credential, a separator, and a value of 8 characters or more without white space or quotes.
CONTEXT = re.compile(r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer|login)\b["']?\x20*(?:[:=]|=>|->|\bis\b)\x20*["']?([^\s"'<>,;]{8,})""")

#: Common words and passwords, most common first; a word costs its rank in guesses.
WORDS = tuple(
    "password 123456 12345678 qwerty admin welcome login letmein dragon monkey master hello shadow sunshine princess football baseball superman iloveyou "
    "trustno1 abc123 secret test guest root user default changeme passw0rd summer winter spring autumn love money internet computer service server "
    "the and that with from this have your company example sample dummy token access private public key placeholder none null true false".split()
)
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))

#: Words of the corpus in the dictionary, besides: the most common ones by documents, of at least so many documents.
CORPUS_WORDS, LEAST_DOCS = 50_000, 5
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,24}(?![^\W\d_])")

#: Rows of a keyboard; a walk is a run of neighbours in a row, either way.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT = {a + b for row in KEYBOARD for a, b in zip(row, row[1:])} | {b + a for row in KEYBOARD for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _alphabet(value: str) -> int:
    return max(10, 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value))


def guess_cost(value: str, ranks: dict[str, int] = RANK, longest: int = _LONGEST) -> float:
    """log10 of the guesses for ``value``: its cheapest segmentation, by dynamic programming over ends.

    Segments are dictionary words (of ``ranks``, up to ``longest`` characters: the rank, times 2 where not all lower case), dates (days of two centuries, or years), repeats (the cost
    of one unit times the count), keyboard walks and alphabet runs (starts times length and directions), and brute-force spans
    (alphabet to the length). A brute-force span next to another is the same as one span, so single characters suffice; each other
    segment adds log10 of 2 for its choice.
    """
    low, n, brute = value.lower(), len(value), log10(_alphabet(value))
    best = [0.0] + [0.0] * n
    dates: dict[int, list[tuple[int, float]]] = {}
    for start in range(n):
        m = _DATE.match(low, start)
        if m:
            dates.setdefault(m.end(), []).append((start, log10(200 if len(m[0]) == 4 else 200 * 366 * 4)))
    run = [1] * (n + 1)  # length of the repeat, walk and alphabet run that ends there
    walk, ramp = [1] * (n + 1), [1] * (n + 1)
    step = 0
    for i in range(1, n):
        run[i + 1] = run[i] + 1 if low[i] == low[i - 1] else 1
        walk[i + 1] = walk[i] + 1 if low[i - 1 : i + 1] in _NEXT else 1
        d = ord(low[i]) - ord(low[i - 1])
        ramp[i + 1] = ramp[i] + 1 if d in (1, -1) and (d == step or ramp[i] == 1) else 2 if d in (1, -1) else 1
        step = d
    same = dict.fromkeys((2, 3, 4), 0)  # by unit: how many characters up to here equal those one unit before
    pair = log10(2)
    for end in range(1, n + 1):
        cost = best[end - 1] + brute
        for start in range(max(0, end - longest), end - 2):
            rank = ranks.get(low[start:end])
            if rank:
                cost = min(cost, best[start] + log10(rank + 1) + pair * (1 + (value[start:end] != low[start:end])))
        for start, c in dates.get(end, ()):
            cost = min(cost, best[start] + c + pair)
        if run[end] >= 3:
            cost = min(cost, best[end - run[end]] + brute + log10(run[end]) + pair)
        if walk[end] >= 3:
            cost = min(cost, best[end - walk[end]] + log10(37 * walk[end] * 2) + pair)
        if ramp[end] >= 3:
            cost = min(cost, best[end - ramp[end]] + log10(36 * ramp[end] * 2) + pair)
        for unit in same:  # repeats of a longer unit
            same[unit] = same[unit] + 1 if end > unit and low[end - 1] == low[end - 1 - unit] else 0
            if same[unit] >= unit:
                times = same[unit] // unit + 1
                cost = min(cost, best[end - times * unit] + unit * brute + log10(times) + pair)
        best[end] = cost
    return best[n]


def scan(text: str, least_cost: float = 12.0, ranks: dict[str, int] = RANK, longest: int = _LONGEST) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, float]]]:
    """Base spans and guess spans of a text, as (start, kind, end) and (start, "guess", end, cost), by start.

    A value in a credential context is a secret if its cheapest segmentation costs ``10 ** least_cost`` guesses or more; nothing else
    counts. Guess spans cover the value alone; one that lies within a base span is left to it, and one that reaches beyond stands beside it.
    """
    base = [(m.start(), "assign", m.end()) for m in BASE["assign"][0].finditer(text) if m.end(2) - m.start(2) >= BASE["assign"][2]]
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in BASE["access"][0].finditer(text) if m.end() - m.start() >= BASE["access"][2]]
    base += [(m.start(), "hex", m.end()) for m in _LONG_HEX.finditer(text)]
    order = {k: i for i, k in enumerate(BASE)}
    base.sort(key=lambda s: (s[0], order[s[1]]))
    extra = []
    for m in CONTEXT.finditer(text):
        value = m[1]
        if not any(s <= m.start(1) and m.end(1) <= e for s, _, e in base):
            cost = guess_cost(value, ranks, longest)
            if cost >= least_cost:
                extra.append((m.start(1), "guess", m.end(1), cost))
    return base, extra


def common_words(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Ranks of the words of ``WORDS``, then of the words that are in most documents: at most CORPUS_WORDS, as many as whole levels of counts allow, of at least LEAST_DOCS.

    Words are runs of 3 to 24 letters, lower-cased, outside the values of credential contexts, so a secret doesn't make itself a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter[str] = Counter()
            for text in batch.column(0):
                text = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], text.as_py() or "")
                c.update(set(_WORD.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = table(counts.filter(F.col("n") >= LEAST_DOCS), "secret-words")
    level, least, held = F.floor(8 * F.log2("n")), None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():  # under 512 rows
        held += r["c"]
        if held > CORPUS_WORDS:
            break
        least = r["level"]
    top = counts.filter(level >= least).collect() if least is not None else []  # no task sends more than that, as a sort with a limit would
    top.sort(key=lambda r: (-r["n"], r["word"]))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *(r["word"] for r in top)]))}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 12.0) -> DataFrame:
    """One row per input row: ``doc_id, spans`` as an array of {kind, start, end, cost}, by start, then kind as listed, guesses last.

    Offsets are code points, ends exclusive. ``cost`` is log10 of the guesses for the span's value; null for access keys and hex runs.
    The cost's dictionary is that of ``common_words`` over the whole table.
    Null texts count as empty and have no spans. Repeated rows are scanned each; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(common_words(docs, text_col))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = words.value
        longest = max(map(len, ranks))
        for f in frames:
            out = []
            for text in f.pop("text"):
                base, extra = scan(text or "", least_cost, ranks, longest)
                found = [(s, k, e, guess_cost(BASE["assign"][0].match(text, s)[2], ranks, longest) if k == "assign" else None) for s, k, e in base] + extra
                order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
                found.sort(key=lambda x: (x[0], order[x[1]]))
                out.append([{"kind": k, "start": s, "end": e, "cost": c} for s, k, e, c in found])
            f["spans"] = out
            yield f

    # ids pass pandas as text: a column of numbers with nulls would become floating point
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.selectExpr(f"CAST(`{id_col}` AS STRING) AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id string, spans array<struct<kind:string,start:long,end:long,cost:double>>")
    return out.selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "spans")
