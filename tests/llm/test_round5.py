"""Words of texts by Arrow in LM scoring: the same words, and a Python object only for each different one."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import lm_scoring
from tessera.llm.common import words_in, words_of


def test_words_are_found_without_an_object_each(monkeypatch):
    """Arrow's words are those of ``words_of`` whatever the white space, and a batch is read without a Python list of its tokens."""
    rng = random.Random(5)
    letters = [*map(chr, range(128)), *"éßÀ\x85\xa0 𝒳", *" \t\n\x0b\x0c\r" * 8]
    texts = ["", None, " ", "\n\t ", " a  B ", *("".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(4000))]
    for part in (texts, texts[:4], [], texts[4:5]):
        words, sizes = words_in(pa.array(part, pa.string()))
        want = [words_of(t) for t in part]
        assert words.to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    looked = []
    find = lm_scoring.Vocabulary.find
    monkeypatch.setattr(lm_scoring.Vocabulary, "find", lambda self, h: (looked.append(len(h)), find(self, h))[1])
    distinct, of, sizes = lm_scoring._ended(pa.array(["a b A"] * 500 + [None], pa.string()))
    v = lm_scoring.Vocabulary.build(*(np.array(x) for x in ([np.uint64(5)], [9])), 9, 1)
    h, at = v.look(distinct)
    t, want = v.tokens(h[of], at[of], sizes), v.read([[*words_of(t), lm_scoring.END] for t in ["a b A"] * 500 + [None]])
    assert looked[0] == 3 and all((getattr(t, k) == getattr(want, k)).all() for k in ("hashes", "at", "leaf", "one", "two", "starts"))
    assert [list(x) for x in (lm_scoring._runs(np.array([3, 3, 9, 1]), 6), lm_scoring._runs(np.array([], int), 6))] == [[(0, 2), (2, 3), (3, 4)], []]
