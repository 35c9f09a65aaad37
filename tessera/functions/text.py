"""Text functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() takes as white space; Java's \s alone lacks U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Word characters; Java's \w alone is ASCII.
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])\s+"


def words(text: Column) -> Column:
    """White-space-separated words."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """A cautious token count: the larger of the number of words and a third of the code points; 0 for an empty text."""
    return F.when(text == "", 0).otherwise(F.greatest(F.size(words(text)), F.floor(F.length(text) / 3))).cast("long")


def terms(text: Column) -> Column:
    """Lower-cased runs of word characters, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def has_terms(text: Column) -> Column:
    return F.lower(text).rlike(WORD)


def counted_terms(text: Column) -> Column:
    """Array of (term, tf) of a text, in the order of the terms: they are sorted, and counts are the lengths of their runs."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).cast("long").alias("tf"))))

    return _let(F.sort_array(terms(text)), runs)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def pack_sentences(text: Column, size: int) -> Column:
    """Sentences packed greedily into pieces of up to ``size`` estimated tokens, joined by a space; a longer sentence is a piece of its own."""
    start = F.named_struct(F.lit("done"), F.array().cast("array<string>"), F.lit("open"), F.lit(None).cast("string"), F.lit("used"), F.lit(0).cast("long"))

    def add(state: Column, sentence: Column) -> Column:
        cost = estimate_tokens(sentence)
        full = state["open"].isNotNull() & (state["used"] + cost > size)
        return F.named_struct(
            F.lit("done"), F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]),
            F.lit("open"), F.when(full | state["open"].isNull(), sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence)),
            F.lit("used"), F.when(full, cost).otherwise(state["used"] + cost),
        )

    return F.aggregate(sentences(text), start, add, lambda s: F.concat(s["done"], F.array(s["open"])))


def decode(content: Column) -> Column:
    """Bytes as UTF-8 with replacement characters, and with every line end as a line feed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def full_text(pages: Column) -> Column:
    """The texts of pages that aren't blank, with an empty line between."""
    return F.array_join(F.transform(F.filter(pages, lambda p: F.size(words(p["text"])) > 0), lambda p: p["text"]), "\n\n")
