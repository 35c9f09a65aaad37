"""Yinyang clustering, personal data and conversation repair: against brute force, and on the awkward cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import conversation_repair as cr
from tessera.llm import crf, pii, yinyang
from tessera.llm.queries import SQL

# op11


def lloyd(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(np.clip(scale * float(x), -yinyang.LARGEST, yinyang.LARGEST))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((-1 if i is None else i), near(v)[1], near(v)[0], centroids[near(v)[1]]) for i, v in kept)


@pytest.mark.parametrize("dims,k,groups,spread", [(4, 7, 3, 1.0), (3, 16, 4, 0.02), (2, 5, 1, 3e6)])
def test_op11_equals_whole_scans(spark, dims, k, groups, spread):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims)) * spread
    rows = [(int(i), [float(x) for x in (centres[i % 6] + rng.normal(size=dims) * spread / 5).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies, and ties
    rows += [(5, rows[3][1]), (None, rows[4][1]), (2000, None), (2001, [1.0] * (dims - 1)), (2002, [float("nan")] + [0.0] * (dims - 1)), (2003, [None] + [0.0] * (dims - 1)), (2004, [float("inf")] * dims), (2005, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)
    got = yinyang.cluster(df, k, 3, dims, 64, groups).collect()
    assert sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["cluster"], r["distance"], r["centroid"]) for r in got) == lloyd(rows, k, 3, dims, 64)
    for r in got:
        assert r["cluster_inertia"] == sum(x["distance"] for x in got if x["cluster"] == r["cluster"]) and r["inertia"] == sum(x["distance"] for x in got)


def test_op11_few_and_no_vectors(spark):
    schema = "vec_id string, embedding array<float>"
    assert yinyang.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    got = yinyang.cluster(spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.5, 0.5]), ("c", [-0.5, 1.0])], schema), dims=2).collect()
    assert {r["vec_id"]: r["distance"] for r in got} == {"a": 0, "b": 0, "c": 0} and len({r["cluster"] for r in got if r["vec_id"] in "ab"}) == 1


def test_op11_bounds_save_scans(monkeypatch):
    """Far groups stay apart, so later rounds scan few centroids; the bounds hold after each round."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 8))
    x = np.repeat(centres, 200, 0) + rng.integers(-40, 40, (2400, 8))
    c = centres + rng.integers(-20, 20, centres.shape)
    group = yinyang.groups_of(c, 4)
    state, cells, plain = yinyang.first_assignment(x, c, group), [0], yinyang.squared
    monkeypatch.setattr(yinyang, "squared", lambda a, b: (cells.__setitem__(0, cells[0] + len(a) * len(b)), plain(a, b))[1])
    for _ in range(3):
        new = c + rng.integers(-3, 4, c.shape)
        state = yinyang.next_assignment(x, new, group, np.sqrt(((new - c) ** 2).sum(1)), *state)
        c = new
        d = np.sqrt(plain(x, c))
        assert (state[0] == plain(x, c).argmin(1)).all() and (state[1] >= d[np.arange(len(x)), state[0]]).all()
        d[np.arange(len(x)), state[0]] = np.inf
        assert all((state[2][:, g] <= d[:, group == g].min(1)).all() for g in range(group.max() + 1))
    assert cells[0] < 3 * len(x) * len(c) / 4


# op12

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "0", "256", "4111111111111111", ".", "@", "a", "b-", "+", " ", "-", "(", ")", "\n", "5555 5555 5555 4444", "é", "+49 (30) 123-4567"]), max_size=40).map("".join))
def test_op12_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    words = "the rain falls on a stone and Der Wind weht über das Meer, la mer est bleue. No! (yes) 12 3.5 1999".split()
    lines = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(120)]
    lines += [" ".join(rng.choice(words) for _ in range(6)) + rng.choice([" a.99@mail7.example.com ", " +1 (839) 555-1724 ", " 10.20.30.40 ", " 4111111111111111 ", " 4111111111111112 "]) + rng.choice(words) for _ in range(80)]
    return pii.train_field(lines)


def test_op12_gradient():
    """The field's training follows the likelihood: against all labellings of a short line, by differences."""
    table = [([b"aa", b"0.0", b"A@a"], np.array([0, 1, 2]), 1.0), ([b"aa", b"aa"], np.array([0, 0]), 2.0)]
    one = crf.train(table, ("", "x", "y"), steps=1, rate=0.0)
    many = crf.train(table, ("", "x", "y"), steps=200, rate=0.05)

    def likelihood(f):
        out = 0.0
        for line, y, w in table:
            e = f.emissions(line, np.zeros(len(line), np.int64))
            score = lambda ls: sum(e[i, k] for i, k in enumerate(ls)) + sum(f.pairs[a, b] for a, b in zip(ls, ls[1:]))  # noqa: B023, E731
            out += w * (score(list(y)) - np.logaddexp.reduce([score(ls) for ls in itertools.product(range(3), repeat=len(line))]))
        return out

    assert likelihood(one) == pytest.approx(-(3 + 4) * np.log(3)) and likelihood(many) > -0.2


def test_op12_decoding_equals_all_labellings(model):
    """Cut at certain words, and with pairs that matter: the best of all labellings."""
    rng = np.random.default_rng(5)
    pool = [b"aaaa", b"aaa.", b"000-0000", b"(000)", b"+0", b"a@a.aa", b"0000", b"00.0.0.0" + crf.QUAD, b"0000000000000000", b"A"]
    for strength in (1.0, 4.0):
        f = crf.Field(model.labels, model.index, [w * 0.3 for w in model.weights], rng.normal(size=(5, 5)) * strength)
        for _ in range(40):
            line = [pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 6))]
            lines = np.sort(rng.integers(0, 2, len(line)))
            e = f.emissions(line, lines)
            score = lambda ls: sum(e[i, k] for i, k in enumerate(ls)) + sum(f.pairs[a, b] for i, (a, b) in enumerate(zip(ls, ls[1:])) if lines[i] == lines[i + 1])  # noqa: B023, E731
            best = max(score(ls) for ls in itertools.product(range(5), repeat=len(line)))
            assert score(f.decode(line, lines)) == pytest.approx(best)


def test_op12_learns_the_table_and_more(model):
    for line in pii.LABELLED:
        text, spans = pii.labelled_line(line)
        shapes, y = pii.labels_of(text, spans)
        assert list(model.decode(shapes, np.zeros(len(shapes), np.int64))) == list(y), line
    # held-out lines: no word of theirs is in the table
    cases = {
        "bitte unter (089) 998-7766 anrufen": ["likely_phone"], "reach me: 312-555-0199, thanks": ["likely_phone"], "schreib an grün@straße.de heute": ["likely_email"],
        "number 2353820953013749 4550997810720808 here": ["likely_card"], "nothing at all: 12 of 345, 6.7 and 2021-03-04.": [], "ordinary words (and more), with \"quotes\" - no data!": [],
        "the id 1234567812345678 isn't one": [],
    }
    for text, want in cases.items():
        assert [k for k, _, _ in pii.added_spans(model, [text.encode()], [pii.base_spans(text)])[0]] == want, text
    text = "tél. (089) 998-7766."
    assert [text[s:e] for _, s, e in pii.added_spans(model, [text.encode()], [[]])[0]] == ["(089) 998-7766"]


def test_op12_query(spark, model):
    rng = random.Random(7)
    texts = [None, "", " \n", "x" * 200_000, "1" * 30_000 + "." * 10, "+1(" * 9_000, "a@" * 20_000, "word " * 40_000 + "a.b@c.de", "é +49 (30) 1234 5678 é 10.1.2.3"] + [" ".join(rng.choice(["sea", "wind", "4111 1111 1111 1111", "a.b@c.de", "300.1.1.1"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, "x@y.zz", 0, 0), (None, "x@y.zz", 0, 0)], "doc_id long, text string, spans int, kind int").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), [tuple(s) for s in r["spans"]]) for r in pii.find_pii(df).collect())
    assert len(got) == len(texts) + 2
    for (null, i), spans in got:
        text = "x@y.zz" if null else texts[i] or ""
        base = [s for s in spans if s[0] in pii.KINDS]
        assert base == plain_spans(text) or (i == 3 and base == plain_spans("x@y.zz"))
        assert all(s[0] in pii.ADDED and 0 <= s[1] < s[2] <= len(text) and not any(s[1] < e and b < s[2] for _, b, e in base) for s in spans[len(base) :])
    assert pii.find_pii(df.limit(0)).count() == 0


# op13


def brute(turns):
    """The cheapest edits by forward search over (cost, letters) without arcs or costs to go."""
    best = {0: (0, "", [])}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for q in list(states):
                role, to = cr.TURN[q]
                c, letters, lines = states[q]
                new = (c + 5, letters + "I", [*lines, f"{role}:"])
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    for t in turns:
        new = {}
        for q, (c, letters, lines) in inserted(best).items():
            for letter, cost, to in t.arcs(q):
                role = t.role if letter == "K" else cr.TURN[q][0]
                way = (c + cost, letters + letter, lines if letter == "D" else [*lines, f"{role}:{t.text}"])
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    return min((w for q, w in inserted(best).items() if q in cr.ENDS), key=lambda w: w[:2])


def plain_repair(rows):
    """{conv_id: result} of (conv, turn, role, text, gone) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text, _ in mine:
            body = re.sub(r"[\x20\x09-\x0d]+$", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append(cr.Turn(role, text, fault))
        known = [r[1] for r in mine if r[1] is not None]
        cost, letters, lines = brute(turns)
        starts = [t.role[:1] for t in turns]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(sum(t.fault == f for t in turns) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(mine))
    return out


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "It rains", "", " \n", "Why?", "so é.", "a b", "…"]
    rows = []
    for c in range(convs):
        for _ in range(rng.randrange(most)):
            rows.append((c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", "", "uncle"]), rng.choice(texts) + rng.choice(["", "", str(rng.randrange(4)) + "."]), rng.random() < 0.1))
    return rows + [(99, 1, "", "", True), (None, 1, "user", "Hi.", False), (None, 2, "assistant", "Ho.", False)]


SCHEMA = "conv_id long, turn long, role string, text string, gone boolean"
FIELDS = [*cr.RESULT[:-1], "repaired_sha256", "n_rows"]


def test_op13_least_letters():
    rng = random.Random(11)
    for _ in range(1500):
        turns = [cr.Turn(rng.choice(["user", "assistant", "system", "x"]), rng.choice("abc"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(9))]
        assert cr.repair(turns) == brute(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in cr.repair(turns)[2]))


@pytest.mark.parametrize("rows_a_block,partitions", [(4096, 4), (3, 7), (1, 2)])
def test_op13_against_brute_force(spark, rows_a_block, partitions):
    """Whatever the blocks and tasks that conversations are cut into."""
    rng = random.Random(rows_a_block)
    rows = random_rows(rng, 25, 14) + [(50, rng.randrange(60), rng.choice(["user", "assistant"]), rng.choice(["Same.", "Other", "More!"]), False) for _ in range(150)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS at", "3 AS whole", "4 AS cost", "5 AS n_rows")
        got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in cr.repair_conversations(df, block_rows=rows_a_block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == plain_repair(rows)


def test_op13_one_row_a_thousand_times(spark):
    """A hot conversation of equal rows, over several tasks: all but the first are deleted."""
    df = spark.range(3000).selectExpr("1L AS conv_id", "7L AS turn", "'user' AS role", "'Hello.' AS text", "false AS gone")
    (r,) = cr.repair_conversations(df, block_rows=200).collect()
    assert (r["duplicate"], r["cost"], r["n_rows"], r["gaps"]) == (2999, 2999 * 2 + 2, 3000, 0) and r["audit"] == "D" * 3000


def test_op13_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((1, "user", "Hi. There?"), (None, None, None), (2, "assistant", "Ho!"))] + [(None, None, "user", "A.")]
    got = sorted((tuple(r) for r in cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        want += [(c, t, "" if k == 0 else "user" if k == 4 else r, "" if k < 2 else re.sub("[.!?]", "", x) if k == 2 else x, k == 0)] * (2 if k == 3 else 1)
    assert got == sorted(want, key=repr)


def test_op13_empty(spark):
    assert cr.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert "op13_conversation_repair" in SQL and "op11_yinyang" in SQL
