"""Structure-aware chunking: text -> blocks -> packed chunks within a token budget.

A document's chunks depend on each other (overlap, budgets), so the work is sequential in a document and parallel across documents:
an Arrow-batched UDF returns each document's chunks as an array. Plain prose needs none of this: see functions.text.pack_sentences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Counter = Callable[[str], int]

CHUNKS = "array<struct<text:string,chunk_index:int,page_number:int>>"
#: Words beyond the overlap that are looked at for sentence ends, and tokens by which the overlap may exceed its size (fixed values).
TAIL_WORDS, OVER_TOKENS = 30, 15

_FENCED = re.compile(r"^(?P<fence>`{3,}|~{3,})[^\n]*\n.*?\n(?P=fence)\s*$", re.MULTILINE | re.DOTALL)
_FENCE_LINE = re.compile(r"(?:`{3,}|~{3,})")
_FENCE_ONLY = re.compile(r"(?:`{3,}|~{3,})\s*$")
_HEADING = re.compile(r"#{1,6}\s+.+$", re.MULTILINE)
_ROW = re.compile(r"\|.+\|$")
_RULE = re.compile(r"\|[\s\-:]+\|")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def estimate_tokens(text: str) -> int:
    """As functions.text.estimate_tokens."""
    return max(len(text.split()), len(text) // 3) if text else 0


@dataclass(frozen=True)
class Block:
    kind: str  # code, table, heading or paragraph
    text: str


def pack(items: Iterable[str], costs: Iterable[int], budget: int, joint: str) -> Iterator[str]:
    """Join neighbours greedily while their costs stay within the budget; an item above it stands alone."""
    held: list[str] = []
    used = 0
    for item, cost in zip(items, costs):
        if held and used + cost > budget:
            yield joint.join(held)
            held, used = [], 0
        held.append(item)
        used += cost
    if held:
        yield joint.join(held)


def _segments(text: str) -> Iterator[tuple[bool, str]]:
    """The text cut at fenced code: (is code, part)."""
    at = 0
    for m in _FENCED.finditer(text):
        yield False, text[at : m.start()]
        yield True, m[0]
        at = m.end()
    yield False, text[at:]


def blocks(text: str) -> Iterator[Block]:
    """Fenced code, headings, tables (runs of rows), and what stands between them: a paragraph, blank lines inside included."""
    kind, lines = "", []

    def close() -> Iterator[Block]:
        nonlocal kind, lines
        body = "\n".join(lines).strip()
        if body:
            yield Block(kind, body)
        kind, lines = "", []

    for code, part in _segments(text):
        if code:
            yield from close()
            yield Block("code", part)
            continue
        for line in part.split("\n"):
            bare = line.strip()
            now = "heading" if _HEADING.match(bare) else "table" if _ROW.match(bare) else "paragraph"
            if now != kind or now == "heading":
                yield from close()
            kind = now
            lines.append(line if now == "paragraph" else bare)
    yield from close()


def split_prose(text: str, size: int, count: Counter) -> Iterator[str]:
    """A long paragraph by sentences; without sentence ends, by words, each of which counts 1."""
    parts = _SENTENCE.split(text)
    if len(parts) > 1:
        return pack(parts, map(count, parts), size, " ")
    parts = text.split()
    return pack(parts, [1] * len(parts), size, " ")


def split_code(text: str, size: int, count: Counter) -> list[str]:
    """Code by lines, with its fences around each piece; whole if it fits."""
    if count(text) <= size:
        return [text]
    lines, top, bottom = text.split("\n"), None, ""
    if _FENCE_LINE.match(lines[0]):
        top, lines = lines[0], lines[1:]
    if lines and _FENCE_ONLY.match(lines[-1]):
        bottom, lines = lines[-1], lines[:-1]
    spent = count(top) + count(bottom) if top is not None else 0
    pieces = pack(lines, map(count, lines), max(size - spent, 1), "\n")
    return [f"{top}\n{p}\n{bottom}" if top is not None else p for p in pieces]


def split_table(text: str, size: int, count: Counter) -> list[str]:
    """A table by rows, with its header, and the rule under it, over each piece; whole if it fits or has under three lines."""
    rows = text.split("\n")
    if count(text) <= size or len(rows) < 3:
        return [text]
    n = 2 if _RULE.match(rows[1]) else 1
    head, rows = "\n".join(rows[:n]), rows[n:]
    return [f"{head}\n{p}" for p in pack(rows, map(count, rows), max(size - count(head), 1), "\n")]


def fit_characters(text: str, size: int, count: Counter) -> Iterator[str]:
    """The longest prefixes that fit, found by bisection, one character at least."""
    while text:
        if count(text) <= size:
            yield text
            return
        fits, over = 1, len(text)
        while over - fits > 1:
            middle = (fits + over) // 2
            fits, over = (middle, over) if count(text[:middle]) <= size else (fits, middle)
        yield text[:fits]
        text = text[fits:]


def fit_words(text: str, size: int, count: Counter) -> Iterator[str]:
    """Runs of words that fit when joined by spaces; a word that doesn't fit is cut into characters."""
    if count is estimate_tokens:
        yield from _fit_words(text, size)
        return
    held = ""
    for word in text.split():
        if count(word) > size:
            if held:
                yield held
            held = ""
            yield from fit_characters(word, size, count)
        elif held and count(f"{held} {word}") > size:
            yield held
            held = word
        else:
            held = f"{held} {word}" if held else word
    if held:
        yield held


def _fit_words(text: str, size: int) -> Iterator[str]:
    """``fit_words`` by ``estimate_tokens``, whose counts are kept as words are added: a run is not counted again for each."""
    held: list[str] = []
    length = -1
    for word in text.split():
        if max(1, len(word) // 3) > size:
            if held:
                yield " ".join(held)
            held, length = [], -1
            yield from fit_characters(word, size, estimate_tokens)
            continue
        if held and max(len(held) + 1, (length + 1 + len(word)) // 3) > size:
            yield " ".join(held)
            held, length = [], -1
        held.append(word)
        length += 1 + len(word)
    if held:
        yield " ".join(held)


def overlap_of(text: str, overlap: int, count: Counter) -> str:
    """What of a chunk is repeated before the next: all if small, else its last sentences, else its last words but the first of them."""
    if overlap <= 0:
        return ""
    if count(text) <= overlap:
        return text
    words = text.split()
    parts = _SENTENCE.split(" ".join(words[-(overlap + TAIL_WORDS) :]))
    if len(parts) == 1:
        return " ".join(words[-overlap:][1:])
    taken, room = len(parts), overlap + OVER_TOKENS
    while taken and (room := room - count(parts[taken - 1])) >= 0:
        taken -= 1
    return " ".join(parts[taken:]).strip()


class _Packer:
    """Chunks in the making: whole pieces out, or blocks gathered up to the budget."""

    def __init__(self, size: int, overlap: int, count: Counter):
        self.size, self.overlap, self.count = size, overlap, count
        self.out: list[str] = []
        self.held: list[str] = []
        self.used = 0

    def flush(self) -> None:
        if merged := "\n\n".join(self.held).strip():
            self.out.append(merged)
        self.held, self.used = [], 0

    def begin(self) -> None:
        """Flush, and begin a chunk with the overlap of the last."""
        self.flush()
        if self.out and (before := overlap_of(self.out[-1], self.overlap, self.count)):
            self.gather(before, self.count(before))

    def gather(self, text: str, cost: int) -> None:
        self.held.append(text)
        self.used += cost

    def add(self, block: Block) -> None:
        cost = self.count(block.text)
        if block.kind in ("code", "table"):
            self.flush()
            self.out += (split_code if block.kind == "code" else split_table)(block.text, self.size, self.count)
        elif block.kind == "paragraph" and cost > self.size:
            self.flush()
            self.out += split_prose(block.text, self.size, self.count)
        else:
            if block.kind == "heading" or self.held and self.used + cost > self.size:
                self.begin()
            self.gather(block.text, cost)


def chunk_text(text: str, size: int = 512, overlap: int = 50, count: Counter = estimate_tokens) -> list[str]:
    """The chunks of a text; none is above ``size``: what still is, is split by words, then characters."""
    if not text.strip():
        return []
    packer = _Packer(size, overlap, count)
    for block in blocks(text):
        packer.add(block)
    packer.flush()
    return [piece for chunk in packer.out for piece in ([chunk] if count(chunk) <= size else fit_words(chunk, size, count))]


def chunk_pages(pages: Iterable[tuple[str, int]], size: int = 512, overlap: int = 50, count: Counter = estimate_tokens) -> list[tuple[str, int, int]]:
    """(text, chunk_index, page_number): pages are chunked each by itself, and chunks numbered through."""
    made = [(piece, number) for text, number in pages for piece in chunk_text(text, size, overlap, count)]
    return [(piece, i, number) for i, (piece, number) in enumerate(made)]


def chunk_parsed(pages: list[tuple[str, int]], size: int, overlap: int, count: Counter = estimate_tokens) -> list[tuple[str, int, int]]:
    """Numbered pages are chunked page by page; a text of one unnumbered page (or several) as one document."""
    if pages and pages[0][1] > 0:
        return chunk_pages(pages, size, overlap, count)
    return chunk_pages([("\n\n".join(t for t, _ in pages if t.strip()), 0)], size, overlap, count)


def chunker(count: Counter = estimate_tokens):
    """A UDF (pages, size, overlap) -> CHUNKS."""

    @F.arrow_udf(CHUNKS)
    def run(pages: pa.Array, size: pa.Array, overlap: pa.Array) -> pa.Array:
        ends, made = [0], []
        texts, numbers = (pages.values.field(k).to_pylist() for k in ("text", "page_number"))
        at, null = pages.offsets.to_pylist(), pages.is_null().to_pylist()
        for i, (s, o) in enumerate(zip(size.to_pylist(), overlap.to_pylist())):
            if not null[i]:
                made += chunk_parsed([(texts[j] or "", numbers[j]) for j in range(at[i], at[i + 1])], s, o, count)
            ends.append(len(made))
        columns = [pa.array([c[k] for c in made], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["text", "chunk_index", "page_number"]))

    return run


def chunk(files: DataFrame, size: Column | int, overlap: Column | int, count: Counter = estimate_tokens) -> DataFrame:
    """A row for each chunk of ``files`` (with ``pages``): the other columns, and text, chunk_index, page_number. Files without chunks give none."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = files.withColumn("__chunk", F.explode(chunker(count)("pages", as_column(size), as_column(overlap)))).drop("pages")
    return made.select(*[c for c in made.columns if c != "__chunk"], "__chunk.*")
