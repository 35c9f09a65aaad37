import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.chunking import blocks, chunk, chunk_pages, chunk_text, estimate_tokens, fit_characters, fit_words, overlap_of, split_code, split_table

DOC = "# Memory\n\nIntro text here.\n\n## Code\n\n```python\ndef f():\n    return 1\n```\n\n## Table\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\nEnd."


def test_blocks():
    assert [(b.kind, b.text) for b in blocks(DOC)] == [
        ("heading", "# Memory"), ("paragraph", "Intro text here."), ("heading", "## Code"), ("code", "```python\ndef f():\n    return 1\n```\n"),  # a blank line behind the fence is taken in
        ("heading", "## Table"), ("table", "| A | B |\n|---|---|\n| 1 | 2 |"), ("paragraph", "End."),
    ]
    assert [b.kind for b in blocks("a\n\nb\n ```\nx\n ```")] == ["paragraph"]  # blank lines don't split, indented fences are text


def test_whole_documents():
    assert chunk_text("") == chunk_text("  \n\n ") == []
    assert chunk_text("Hello world.") == ["Hello world."]
    assert chunk_text(DOC, 500, 0) == ["# Memory\n\nIntro text here.", "## Code", "```python\ndef f():\n    return 1\n```\n", "## Table", "| A | B |\n|---|---|\n| 1 | 2 |", "End."]


def test_pages():
    assert chunk_pages([("One.", 1), ("   ", 2), ("Three.", 3)]) == [("One.", 0, 1), ("Three.", 1, 3)]


def test_code_and_tables():
    code = "```py\n" + "\n".join(f"line_{i} = {i}" for i in range(100)) + "\n```"
    pieces = split_code(code, 20, estimate_tokens)
    assert len(pieces) > 1 and all(p.startswith("```py\n") and p.endswith("\n```") for p in pieces)
    assert len(split_code("just plain text\nwith lines\nand more", 3, estimate_tokens)) == 3
    table = "\n".join(["| N | V |", "| --- | --- |", *(f"| i{i} | {i} |" for i in range(50))])
    pieces = split_table(table, 20, estimate_tokens)
    assert len(pieces) > 1 and all(p.startswith("| N | V |\n| --- | --- |\n") for p in pieces)


def test_fitting():
    blob = "0xff02" * 500
    assert "".join(fit_characters(blob, 200, len)) == blob and all(len(p) <= 200 for p in fit_characters(blob, 200, len))
    assert list(fit_characters("abc", 10, lambda t: 999)) == ["a", "b", "c"]
    assert all(len(p) <= 100 for p in fit_words("tiny " + "A" * 950 + " more", 100, len))


def test_overlap():
    count = lambda t: len(t.split())
    assert overlap_of("a b c", 0, count) == "" and overlap_of("a b c", 3, count) == "a b c"
    assert overlap_of("a b c d e", 3, count) == "d e"  # no sentence ends: the last three words but the first
    long = " ".join(f"w{i}." for i in range(60))
    assert overlap_of(long, 5, count) == " ".join(f"w{i}." for i in range(40, 60))
    chunks = chunk_text("First sentence of context. Second sentence of context.\n\n# New\n\nContent.", 30, 20)
    assert chunks[1] == f"{chunks[0]}\n\n# New\n\nContent."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# H", "word. Another one!", "| a | b |", "```", "~~~", "", "x" * 40, "a b c d", "  y", "\x00", "é?"]), max_size=25), st.integers(1, 40), st.integers(0, 20))
def test_properties(lines, size, overlap):
    text = "\n".join(lines)
    for count in (len, estimate_tokens):
        out = chunk_text(text, size, overlap, count)
        assert out == chunk_text(text, size, overlap, count)
        assert all(count(c) <= size or len(c) == 1 for c in out)
        assert set("".join(text.split())) == set("".join("".join(out).split()))


def test_operator(spark):
    df = spark.createDataFrame([("a", [(DOC, 0)]), ("b", [("", 0)]), ("c", [("P1.", 1), ("P2.", 2)])], "name string, pages array<struct<text:string,page_number:int>>")
    got = sorted((r["name"], r["chunk_index"], r["page_number"]) for r in chunk(df, 500, 0).collect())
    assert got == [("a", i, 0) for i in range(6)] + [("c", 0, 1), ("c", 1, 2)]


def test_missing_tokenizer():
    from tessera.sources.tokenizers import counters

    with pytest.raises(KeyError):
        counters({})["x"]
