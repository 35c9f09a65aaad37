"""Personal data: fixed patterns, and spans that a conditional random field over word shapes adds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches
from .crf import Field, luhn, tokens, train

#: Kinds in their order; the field's own follow them.
KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"likely_{k}" for k in KINDS)
LABELS = ("", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does, and each number of it takes its whole run: the same matches as of the plain pattern, without trying again from within runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

#: The small labelled table, a line each, spans in brackets after their kind.
LABELLED = """
Call me at [phone (555) 123-4567] before noon.
Phone: [phone 555-123-4567] or [phone 555-987-6543]
tel. [phone 030 1234567] or mobile [phone 0171 2345678], after six.
You can reach us under [phone +49 30 1234567] on weekdays.
Fax [phone 555.123.4567], attention of the manager.
My number is [phone 555-0100-222] and hers is [phone 555-0100-333].
ring [phone (020) 7946-0958] and ask for the desk
Office [phone +1 (202) 555-0147] extension 12
new number: [phone 202-555-0182]; the old one is dead
Téléphone [phone 01 23 45 67 89] le soir
Write to [email jane.doe@example.com] or to [email sales@shop.example.org].
Contact: [email jörg@müller.de], he knows.
mail [email root@localhost] if the job fails
an [email hans@büro.example] morgen
ask [email maría@correo.example] about it
please send it to [email a_b+c@mail.example.net]!
Email [email o'brien@example.ie] by Friday
From: [email someone@example] To: [email other.person@sub.example.co]
The server [ip 10.0.0.12] answers, [ip 192.168.1.255] doesn't.
Blocked [ip 203.0.113.7] after three tries.
ping [ip 2001:db8::1] and [ip fe80::1ff:fe23:4567:890a] from here
Client [ip 2001:db8:85a3::8a2e:370:7334] connected
Login from [ip 198.51.100.23], again from [ip 198.51.100.24].
Card [card 4111 1111 1111 1111] expires 12/27
paid with [card 4111111111111111] yesterday
[card 5500-0055-5555-5559] was declined
card number [card 4111 11XX XXXX 1111] on file
ending in [card XXXX-XXXX-XXXX-1234] as before
VISA [card 4012888888881881] and MC [card 5555555555554444]
The order 20240506 was sent on 2024-05-06 at 10:15.
It costs $1,234.56 or 1.234,56 EUR, about 12.5% more.
Version 4.0. of the license, or v2.0.1, see section 3.2.1.
| line | part | n | 1 | 155190 | 17 |
Chapter 12 has 345 pages, 1999 to 2004, and 7 plates.
The reference 4111111111111112 has no meaning, nor has 1234567890123456.
Password: a9f3c2d4e5b6a7f8 token=9f8e7d6c5b4a39281706
ISBN 978-3-16-148410-0, printed 1998.
Temperatures of -12 to 30 degrees, 3.14 and 2.718 among 10000 others.
See https://www.example.com/a/b?c=1&d=2 for more.
at 12:30:45 on 01.02.2023 the count was 99,999
Room 101-203 is on floor 3 (see map 4-5).
build 1.2.3 follows 1.2.2; 999.999.999.999 is no address
He scored 21-14 and 7-6, 6-4 in 2012/13.
the rain falls on a stone and the sea is (almost) still
Ein Satz ohne Zahlen, nur Wörter: eins, zwei, drei!
This is: the end. Or is it? No - it was "only" a word.
@someone said #hello to @everyone_else
serial AB-1234-CD and plate M-XY 1234
3 + 4 = 7, (5 + 6) * 2 = 22, x - y > 0
""".strip().split("\n")
_SPAN = re.compile(r"\[(email|ip|card|phone) ([^\]]+)\]")

#: The documents, by least hash of their text, whose windows of WINDOW words stand for ordinary text in training: those around base spans, which carry their labels, and some others. A bounded sample.
SAMPLE_DOCS, WINDOW, WINDOWS = 400, 24, 6
#: How often a line of the labelled table counts, against a window.
WEIGHT = 4.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
        free = host.end() if host else at + 1  # no address reaches back over an @
        at = text.find("@", free)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if max(map(_octet, m[0].split("."))) <= 255]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def _octet(digits: str) -> int:
    """A number of at most three digits, leading zeros aside; 256 stands for all that are longer."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= 3 else 256


def labelled_line(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of the table without its brackets, and its spans."""
    spans, out, last = [], "", 0
    for m in _SPAN.finditer(line):
        out += line[last : m.start()]
        spans.append((m[1], len(out), len(out) + len(m[2])))
        out, last = out + m[2], m.end()
    return out + line[last:], spans


def labels_of(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[bytes], np.ndarray]:
    """(shapes, labels) of a text's words: a word has the label of a span that it touches."""
    shapes, starts, ends, _ = tokens(text.encode("utf-8", "surrogatepass"))
    y = np.zeros(len(shapes), np.int64)
    for kind, s, e in spans:
        s, e = len(text[:s].encode("utf-8", "surrogatepass")), len(text[:e].encode("utf-8", "surrogatepass"))
        y[(starts < e) & (ends > s)] = LABELS.index(kind)
    return shapes, y


def windows(text: str, most: int = WINDOWS, size: int = WINDOW) -> list[str]:
    """Pieces of about ``size`` words in single lines: around base spans for up to two thirds of ``most``, the others spread over the text."""
    spans = base_spans(text)
    words = list(re.finditer(r"[^\x20\x09-\x0d]+", text))
    if not words:
        return []
    starts = np.array([m.start() for m in words])
    at = [int(np.searchsorted(starts, s, "right")) - 1 for _, s, _ in spans[:: max(1, -(-len(spans) * 3 // (2 * most)))]]
    at += [len(words) * (2 * i + 1) // (2 * (most - len(at))) for i in range(most - len(at))]
    out = []
    for i in dict.fromkeys(at):
        a, b = max(0, i - size // 2), min(len(words), i + size // 2)
        cut = [s for _, s, e in spans if s < words[a].start() < e] + [e for _, s, e in spans if s < words[b - 1].end() < e]
        if not cut:  # a span that a border would cut would have a wrong label
            out.append(re.sub(r"[\x09-\x0d]", " ", text[words[a].start() : words[b - 1].end()]))
    return out


def training_windows(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Windows of the ``SAMPLE_DOCS`` distinct texts of least hash; every text takes part in the choice."""
    texts = docs.select(F.col(text_col).alias("text")).filter("text <> ''")
    last = texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column(0) for w in windows(t.as_py())], pa.string())], ["line"])

    some = texts.filter(F.xxhash64("text") <= last).mapInArrow(run, "line string").distinct()
    return sorted(r["line"] for r in some.collect())  # at most WINDOWS windows a text


def train_field(lines: list[str], labelled: list[str] | None = None) -> Field:
    """A field from the labelled table and windows, whose labels are those of the base patterns."""
    rows = [(*labels_of(*labelled_line(x)), WEIGHT) for x in (LABELLED if labelled is None else labelled)]
    rows += [(*labels_of(x, base_spans(x)), 1.0) for x in lines]
    return train(rows, LABELS)


_LEFT, _RIGHT = b"\t .,;:!?)]}<>\"'*#$%&|/\\-_=~^`[{", b"\t .,;:!?(]}[{<>\"'*#$%&|/\\-_=~^`+"


def added_spans(model: Field, texts: list[bytes], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text and no base span touches: runs of words of one label in a line, without the punctuation around them."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    joined = b"\n".join(texts)
    shapes, starts, ends, lines = tokens(joined)
    if not shapes:
        return out
    y = model.decode(shapes, lines)
    hit = np.flatnonzero(y)
    if not len(hit):
        return out
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
    fresh = np.concatenate([[True], (np.diff(hit) > 1) | (y[hit[1:]] != y[hit[:-1]]) | (lines[hit[1:]] != lines[hit[:-1]])])
    first = np.flatnonzero(fresh)
    for a, b in zip(hit[first], hit[np.append(first[1:], len(hit)) - 1]):
        s, e = int(starts[a]), int(ends[b])
        piece = joined[s:e]
        s += len(piece) - len(piece.lstrip(_LEFT))
        e -= len(piece) - len(piece.rstrip(_RIGHT))
        if s < e:
            i = int(np.searchsorted(begins, s, "right")) - 1
            zero = points[begins[i]]
            span = (f"likely_{LABELS[y[a]]}", int(points[s] - zero), int(points[e] - zero))
            if not any(span[1] < z and x < span[2] for _, x, z in base[i]):
                out[i].append(span)
    return [sorted(x, key=lambda s: (ADDED.index(s[0]), s[1])) for x in out]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, spans`` as an array of {kind, start, end}: base spans by kind (email, ip, card, phone), then start; then those that the field adds, as likely_*.

    Offsets are code points, ends exclusive. Texts of any length are taken whole. Null texts count as empty and have no spans; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    The field is trained on the driver from the ``labelled`` table (LABELLED) and a bounded sample of windows of the corpus, and every word of every text is decoded with it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train_field(training_windows(docs, text_col), labelled))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(model.value, [t.encode("utf-8", "surrogatepass") for t in texts], base)
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in b + m] for b, m in zip(base, more)], arrow.field("spans").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
