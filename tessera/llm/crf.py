"""A linear-chain conditional random field over the shapes of words: trained and decoded in numpy, many lines at once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: What a word's bytes look like: lower-case letters (and all beyond ASCII) as a, upper-case as A, digits as 0; all else stays.
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
#: Marks behind the shapes of numbers that pass Luhn's check, and of four numbers up to 255.
LUHN, QUAD = b"\x02", b"\x03"
#: Words of so many digits have the checks.
_CHECKED = 4
_RUN = re.compile(rb"a+|A+|0+")


def luhn(digits: bytes | str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits.encode() if isinstance(digits, str) else digits)):
        v = c - 48
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


def checked(shape: bytes, word: bytes) -> bytes:
    """The shape with the mark of a check that the word's digits pass."""
    core = word.strip(b".,;:!?()[]{}<>\"'*#$%&|/\\-_=~^`")
    digits = core.replace(b"-", b"")
    if 13 <= len(digits) <= 19 and digits.isdigit():
        return shape + LUHN if luhn(digits) else shape
    parts = core.split(b".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return shape + QUAD
    return shape


def features(shape: bytes) -> list[str]:
    """What the field sees of a word: nothing but its shape and marks."""
    short = _RUN.sub(lambda m: m[0][:1] if m[0][:1] != b"0" or len(m[0]) > 4 else m[0], shape).decode("latin-1")
    flat = _RUN.sub(lambda m: m[0][:1], shape).decode("latin-1")
    core = short.strip(".,;:!?()[]{}<>\"'")
    digits, letters = shape.count(b"0"), shape.count(b"a") + shape.count(b"A")
    size = next(k for k, most in enumerate((0, 2, 4, 6, 8, 12, 19, 1 << 60)) if digits <= most)
    out = ["bias", f"short={short}", f"flat={flat}", f"core={core}", f"digits={size}", f"letters={min(letters, 3)}", f"first={flat[:1]}", f"last={flat[-1:]}", f"digits={size},letters={min(letters, 1)},dots={min(shape.count(b'.'), 4)},dashes={min(shape.count(b'-'), 4)}"]
    out += [f"has={c}" for c in "@.-+(:/\x02\x03" if c.encode() in shape]
    if "@" in flat:
        name, _, host = flat.partition("@")
        out.append(f"at={bool(name)},{'.' in host.strip('.')},{host.count('@')}")
    return out


#: A place without a word: before the first of a line and after the last.
NO_WORD = b"\x01"
#: Of the words around, the field sees these.
_NEAR = ("short=", "digits=", "last=", "has=")


def near_features(shape: bytes) -> list[str]:
    return ["none"] if shape == NO_WORD else [f for f in features(shape) if f.startswith(_NEAR) and "," not in f]


def tokens(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(shapes, starts, ends, line numbers) of the words of a text."""
    a = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    lines = np.searchsorted(np.flatnonzero(a == 10), starts)
    shapes = text.translate(SHAPE).split()
    for i in np.flatnonzero(ends - starts >= 7):  # the shortest address has seven characters
        if shapes[i].count(b"0") >= _CHECKED:
            shapes[i] = checked(shapes[i], text[starts[i] : ends[i]])
    return shapes, starts, ends, lines


@dataclass
class Field:
    """Weights of features of a word (0), the one before (1) and the one after (2), by label; and of label pairs. Label 0 is none. Features that training hasn't seen weigh nothing."""

    labels: tuple[str, ...]
    index: list[dict[str, int]]
    weights: list[np.ndarray]
    pairs: np.ndarray
    rows: dict[bytes, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)
    used: int = 0

    def _add(self, shape: bytes) -> int:
        if not self.scores or self.used == len(self.scores[0]):
            grown = [np.zeros((max(1024, 2 * self.used), len(self.labels))) for _ in range(3)]
            for new, old in zip(grown, self.scores):
                new[: len(old)] = old
            self.scores = grown
        for k, of in enumerate((features, near_features, near_features)):
            at = [self.index[k][f] for f in (of(shape) if shape != NO_WORD or k else []) if f in self.index[k]]
            self.scores[k][self.used] = self.weights[k][at].sum(0)
        self.rows[shape] = self.used
        self.used += 1
        return self.used - 1

    def numbers(self, shapes: list[bytes], most: int = 200_000) -> np.ndarray:
        """Rows of the tables of scores, which are made as shapes come up; beyond ``most`` shapes the tables start anew, so memory is bounded."""
        if self.used > most:
            self.rows, self.scores, self.used = {}, [], 0
        if NO_WORD not in self.rows:
            self._add(NO_WORD)
        rows, add = self.rows, self._add
        for s in set(shapes) - rows.keys():
            add(s)
        return np.fromiter(map(rows.__getitem__, shapes), np.int64, len(shapes))

    def emissions(self, shapes: list[bytes], lines: np.ndarray) -> np.ndarray:
        if not shapes:
            return np.zeros((0, len(self.labels)))
        at = self.numbers(shapes)
        none, new = self.rows[NO_WORD], lines[1:] != lines[:-1]
        before, after = np.concatenate([[none], np.where(new, none, at[:-1])]), np.concatenate([np.where(new, none, at[1:]), [none]])
        return self.scores[0][at] + self.scores[1][before] + self.scores[2][after]

    def certain(self, e: np.ndarray) -> np.ndarray:
        """Words whose best label is none whatever the labels around: none leads every other label by more than that label could gain from its pairs on both sides."""
        p = self.pairs
        gain = np.maximum((p[:, 1:] - p[:, :1]).max(0), 0) + np.maximum((p[1:, :] - p[:1, :]).max(1), 0)
        return (e[:, :1] - e[:, 1:] > gain + 1e-9).all(1)

    def viterbi(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Best labels of runs of words (rows of e from starts, sizes long), all runs a step at a time. ``left`` and ``right`` tell which have a word labelled none beside them; ties go to the lesser label."""
        out = np.zeros(len(e), np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, left, right = starts[order], sizes[order], left[order], right[order]
        live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes.max(initial=0)))]
        back: list[np.ndarray] = []
        score = e[starts] + np.where(left[:, None], self.pairs[0], 0)
        for t, n in enumerate(live[1:], 1):
            s = score[:n, :, None] + self.pairs
            back.append(s.argmax(1))
            score[:n] = s.max(1) + e[starts[:n] + t]
        now = (score + np.where(right[:, None], self.pairs[:, 0], 0)).argmax(1)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            out[starts[:n] + t] = now[:n]
            if t:
                now[:n] = back[t - 1][np.arange(n), now[:n]]
        return out

    def decode(self, shapes: list[bytes], lines: np.ndarray) -> np.ndarray:
        """The best labels of all words. Certain words cut the lines into short runs, which are decoded side by side: the same labels as of whole lines."""
        e = self.emissions(shapes, lines)
        free = np.concatenate([[False], ~self.certain(e), [False]])
        edge = np.concatenate([[True], lines[1:] != lines[:-1], [True]]) if len(e) else np.array([True])
        first = np.flatnonzero(free[1:-1] & (~free[:-2] | edge[:-1]))
        last = np.flatnonzero(free[1:-1] & (~free[2:] | edge[1:]))
        return self.viterbi(e, first, last - first + 1, ~edge[first], ~edge[last + 1])


def train(table: list[tuple[list[bytes], np.ndarray, np.ndarray]], labels: tuple[str, ...], steps: int = 150, batch: int = 256, rate: float = 0.1, decay: float = 1e-3, seed: int = 1) -> Field:
    """A field from labelled lines (shapes, label numbers, weight): gradients of the likelihood by forward and backward sums, in batches of lines padded to one length; at least ``steps`` Adam steps in whole passes."""
    count = len(labels)
    index: list[dict[str, int]] = [{}, {}, {}]
    shapes = sorted({s for line, _, _ in table for s in line} | {NO_WORD})
    number = {s: i for i, s in enumerate(shapes)}
    lists = []
    for k, of in enumerate((features, near_features, near_features)):
        lists.append([[index[k].setdefault(f, len(index[k])) for f in (of(s) if s != NO_WORD or k else [])] for s in shapes])
    weights, pairs = [np.zeros((max(1, len(i)), count)) for i in index], np.zeros((count, count))
    flat = [(np.repeat(np.arange(len(shapes)), [len(x) for x in of]), np.array([i for x in of for i in x], np.int64)) for of in lists]
    rng, step = np.random.default_rng(seed), 0
    values = [*weights, pairs]
    m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def spread(k: int) -> np.ndarray:
        out = np.zeros((len(shapes), count))
        np.add.at(out, flat[k][0], weights[k][flat[k][1]])
        return out

    def gathered(k: int, by_shape: np.ndarray) -> np.ndarray:
        out = np.zeros_like(weights[k])
        np.add.at(out, flat[k][1], by_shape[flat[k][0]])
        return out

    padded = [([number[NO_WORD], *(number[s] for s in line), number[NO_WORD]], y, w) for line, y, w in table if line]
    while padded and step < steps:
        order = rng.permutation(len(padded))
        for at in range(0, len(order), batch):
            part = [padded[i] for i in order[at : at + batch]]
            size = max(len(y) for _, y, _ in part)
            n = len(part)
            ids, gold, here = np.full((n, size + 2), number[NO_WORD]), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
            heavy = np.array([float(w) for _, _, w in part])
            for i, (s, y, _) in enumerate(part):
                ids[i, : len(s)], gold[i, : len(y)], here[i, : len(y)] = s, y, True
            s0, s1, s2 = spread(0), spread(1), spread(2)
            e = s0[ids[:, 1:-1]] + s1[ids[:, :-2]] + s2[ids[:, 2:]]
            alpha, beta = np.zeros((n, size, count)), np.zeros((n, size, count))
            alpha[:, 0] = e[:, 0]
            for t in range(1, size):
                alpha[:, t] = np.where(here[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + pairs, 1) + e[:, t], alpha[:, t - 1])
            for t in range(size - 2, -1, -1):
                beta[:, t] = np.where(here[:, t + 1, None], np.logaddexp.reduce(pairs + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            z = np.logaddexp.reduce(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * here[..., None]
            wrong = (np.eye(count)[gold] * here[..., None] - p) * heavy[:, None, None] / heavy.sum()
            grads = []
            for k, ids_k in enumerate((ids[:, 1:-1], ids[:, :-2], ids[:, 2:])):
                by_shape = np.zeros((len(shapes), count))
                np.add.at(by_shape, ids_k.ravel(), wrong.reshape(-1, count))
                grads.append(gathered(k, by_shape))
            both = here[:, 1:]
            pair = np.zeros((count, count))
            np.add.at(pair, (gold[:, :-1][both], gold[:, 1:][both]), np.broadcast_to(heavy[:, None], both.shape)[both])
            q = np.exp(alpha[:, :-1, :, None] + pairs + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            grads.append((pair - (q * heavy[:, None, None, None]).sum((0, 1))) / heavy.sum())
            step += 1
            for x, g, mm, vv in zip(values, grads, m, v):
                g = g - decay * x / 10
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                x += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Field(labels, index, weights, pairs)
