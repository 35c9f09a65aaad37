"""LM scoring by online logistic context mixing: hashed-context bit predictors, gated weights, adaptive refinement."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import blake2b
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import in_fold, small_batches, table, words_in

#: No word holds white space, so this is no word.
END = b"\n"
#: Most words whose counts travel with the tasks (12 bytes each); counts of the rest come by a join.
MAX_COUNTED = 400_000
#: Most words that are leaves of the code tree; the rest are an escape, then their discounted count, or a spelling by bytes. On held-out text (1,600 training
#: documents) a token cost 11.96 bits with 131,072 leaves, 11.89 with 30,000 and 11.97 with 4,096, at 11.7, 9.7 and 6.6 decisions a token.
MAX_LEAVES = 4096
#: Slots of the hashed bit counters: of each word context, and of each byte context.
WORD_BITS, BYTE_BITS = 20, 18
#: Taken off the count of each word without a leaf, for words never seen in training.
DISCOUNT = 0.75
#: Tokens whose code bits are held at once; longer texts go piece by piece.
PIECE = 20_000
#: Words of an anchor, and one in how many places is one. Anchors are contexts in a table as large as the training text has anchors.
ANCHOR_WORDS, ANCHOR_EVERY = 4, 32
#: Bits of a text's first block; each next one has twice as many, up to LAST_BLOCK.
FIRST_BLOCK, LAST_BLOCK = 64, 16_384
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slot of each pair of a mixed 32-bit context and a node."""
    x = node.astype(np.uint32) * _M2
    x ^= context
    x *= _M1
    x >>= np.uint32(32 - bits)
    return x


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p)).astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Mixer:
    """Logistic mixing with one weight vector for each gate, then a refinement table over (gate group, stretched prediction)."""

    weights: np.ndarray  # inputs x gates
    refine: np.ndarray = field(default_factory=lambda: np.tile(squash((np.arange(33) - 16) / 2.0), 2).astype(np.float32))
    rate: float = 0.001

    @property
    def gates(self) -> int:
        return self.weights.shape[1]


def _mixed(weights: np.ndarray, inputs: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The weighted sum of the inputs, held within 8 either way."""
    x = weights[0].take(at, mode="clip")
    x *= inputs[0]
    for w, v in zip(weights[1:], inputs[1:]):
        y = w.take(at, mode="clip")
        y *= v
        x += y
    return np.clip(x, -8, 8, out=x)


class Lanes:
    """A copy of a mixer for each of several texts, side by side. Weights and table of a lane learn from its bits as they come:
    ``step`` predicts a block of each lane with what was learned before, then updates.
    """

    def __init__(self, mixer: Mixer, n: int = 1):
        self.weights, self.refine, self.rate, self.gates = np.tile(mixer.weights, (1, n)), np.tile(mixer.refine, n), mixer.rate, mixer.gates

    def step(self, inputs: list[np.ndarray], at: np.ndarray, cell: np.ndarray, bits: np.ndarray, learn: bool = True) -> np.ndarray:
        """Bits of information in each of ``bits``; each predictor's ``inputs`` are stretched, and ``at`` and ``cell`` are those of ``places``."""
        x = _mixed(self.weights, inputs, at)
        p = np.negative(x)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        x += x
        cell = np.rint(x, out=x).astype(np.intp) + cell
        final = self.refine.take(cell, mode="clip")
        final += p
        final *= np.float32(0.5)
        if learn:
            error = bits - p
            error *= np.float32(self.rate)
            for w, v in zip(self.weights, inputs):
                w += np.bincount(at, np.multiply(error, v, dtype=np.float64), len(w))
            cell += cell
            cell += bits
            zeros, ones = np.bincount(cell, minlength=2 * len(self.refine)).reshape(-1, 2).T
            n = zeros + ones
            self.refine += (ones - n * self.refine) / (n + 200.0)
        np.subtract(1, final, out=final, where=bits == 0)
        np.maximum(final, np.float32(1e-6), out=final)
        return -np.log2(final, out=final)

    def places(self, gate: np.ndarray, lane: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where bits of these gates and lanes find their weights, and the middle of their part of the refinement table."""
        return gate + self.gates * lane, np.where(gate > 0, 49, 16) + 66 * lane


#: Codes of counters: counts of zeros and ones up to 15 as they are, and beyond that the stretched share in steps of 1/16, for n up to 63 and above.
_SMALL, _STEPS = 256, 481
_CODES = _SMALL + 2 * _STEPS


def _shares(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), dtype=np.float32)


def _meaning() -> tuple[np.ndarray, np.ndarray]:
    """Of each code as it is, less a zero, and less a one: the stretched share of ones, and how sure it is (0 for never seen, to 4)."""
    shares, sure = np.zeros((3, _CODES), np.float32), np.zeros((3, _CODES), np.uint8)
    shares[:, _SMALL:] = np.tile((np.arange(_STEPS) - _STEPS // 2) / 16.0, 2)
    sure[:, _SMALL:] = np.repeat([3, 4], _STEPS)
    zeros, ones = np.arange(_SMALL) >> 4, np.arange(_SMALL) & 15
    for k, (z, o) in enumerate([(zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))]):
        n = z + o
        shares[k, :_SMALL], sure[k, :_SMALL] = _shares(z, o), (n > 0).astype(np.uint8) + (n > 3) + (n > 15)
    return shares.ravel(), sure.ravel()


_SHARE, _SURE = _meaning()


@dataclass
class Predictors:
    """What hashed counters predict, by context and slot, as codes of 16 bits."""

    codes: np.ndarray

    @classmethod
    def build(cls, counters: np.ndarray) -> Predictors:
        """From counts, contexts x (slots x 2)."""
        out = np.empty((len(counters), counters.shape[1] // 2), np.uint16)
        for c, codes in zip(counters, out):
            zeros, ones = c[0::2], c[1::2]
            level = np.rint(np.clip(_shares(zeros, ones), -15, 15) * 16).astype(np.int16) + (_SMALL + _STEPS // 2) + _STEPS * (zeros + ones > 63)
            codes[:] = np.where((zeros < 16) & (ones < 16), zeros << 4 | ones, level)
        return cls(out)

    def at(self, k: int, slots: np.ndarray, less: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shares and sureness; ``less`` takes each bit itself off its counter, for fitting on counted text (large counts stay as they are)."""
        code = self.codes[k].take(slots, mode="clip").astype(np.intp)
        if less is not None:
            code += _CODES * (less + np.intp(1))
        return _SHARE.take(code, mode="clip"), _SURE.take(code, mode="clip")


def _code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code of leaves: where each leaf's path begins, nodes and bits of all paths, and each node's stretched share of ones."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit, one = {}, {}, []
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        node = n + len(one)
        parent[i] = parent[j] = node
        bit[i], bit[j] = 0, 1
        one.append((b + 0.5) / (a + b + 1))
        heapq.heappush(heap, (a + b, node))
    starts, nodes, bits = [0], [], []
    for leaf in range(n):
        path, at = [], leaf
        while at in parent:
            path.append((parent[at] - n, bit[at]))
            at = parent[at]
        path.reverse()
        nodes += [x for x, _ in path]
        bits += [x for _, x in path]
        starts.append(len(nodes))
    return np.array(starts, np.int32), np.array(nodes, np.int32), np.array(bits, np.int8), stretch(np.array(one or [0.5]))


@dataclass
class Tokens:
    """Tokens of several texts end to end: each one's hash, index in the vocabulary (or -1) and leaf, two mixed contexts, and where each text begins."""

    hashes: np.ndarray
    at: np.ndarray
    leaf: np.ndarray
    one: np.ndarray
    two: np.ndarray
    starts: np.ndarray

    def only(self, some: np.ndarray) -> Tokens:
        """The tokens of a mask, with the contexts that they have; texts are no longer told apart."""
        return Tokens(*(x[some] for x in (self.hashes, self.at, self.leaf, self.one, self.two)), np.zeros(1, np.int64))


@dataclass
class Vocabulary:
    """Counted words by hash, their counts, and their leaves (the escape's for words without one); the tree's paths and each node's stretched share of ones."""

    hashes: np.ndarray
    counts: np.ndarray
    leaves: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    shares: np.ndarray
    escape: int
    total: int
    distinct: int
    rest: int  # tokens of words without a leaf
    rest_types: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> Vocabulary:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        top = np.lexsort((hashes, -counts))[:MAX_LEAVES]
        leaves = np.full(len(hashes), len(top), np.int32)
        leaves[top] = np.arange(len(top))
        rest = total - int(counts[top].sum())
        return cls(hashes, counts, leaves, *_code_tree(np.append(counts[top], max(1, rest))), len(top), total, distinct, rest, distinct - len(top))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1).astype(np.int32)

    def look(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and index (or -1) of words."""
        h = _hashes(words)
        return h, self.find(h)

    def read(self, texts: list[list[bytes]]) -> Tokens:
        """Tokens of texts in words."""
        return self.tokens(*self.look([w for t in texts for w in t]), np.array([len(t) for t in texts]))

    def unpack(self, packed: list[bytes], rare: list[bytes]) -> Tokens:
        """Tokens of texts as ``packed`` has left them: indices, and below 0 places in the list of the text's rare hashes."""
        at = np.frombuffer(b"".join(packed), np.int32)
        sizes = np.array([len(x) // 4 for x in packed])
        bases = np.cumsum([0, *(len(x) // 8 for x in rare)])[:-1]
        hashes = np.frombuffer(b"".join(rare), np.uint64)
        h = self.hashes.take(np.maximum(at, 0), mode="clip") if len(self.hashes) else np.zeros(len(at), np.uint64)
        out = np.flatnonzero(at < 0)
        h[out] = hashes[np.repeat(bases, sizes)[out] - 1 - at[out]]
        return self.tokens(h, at, sizes)

    def tokens(self, h: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Tokens:
        starts = np.cumsum(sizes) - sizes
        leaf = np.where(at >= 0, self.leaves.take(np.maximum(at, 0), mode="clip"), self.escape) if len(self.leaves) else np.full(len(at), self.escape)
        mixed = h * _K1
        one, two = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        one[1:], two[2:] = mixed[:-1], h[:-2]
        one[starts] = two[starts] = 0
        two[(starts + 1)[sizes > 1]] = 0
        two = (one ^ two) * _K3 + _K2
        return Tokens(h, at, leaf, (one >> np.uint64(32)).astype(np.uint32), (two >> np.uint64(32)).astype(np.uint32), starts)

    def coded(self, t: Tokens, a: int = 0, b: int | None = None) -> tuple[np.ndarray, ...]:
        """Of tokens a to b: how many code bits each has, and every bit's node, bit and slots in both contexts."""
        leaf = t.leaf[a:b]
        begin = self.starts[leaf]
        size = self.starts[leaf + 1] - begin
        ends = np.cumsum(size, dtype=np.int32)
        i = np.repeat(begin - ends + size, size)
        i += np.arange(len(i), dtype=np.int32)
        nodes = self.nodes.take(i, mode="clip")
        return size, nodes, self.bits.take(i, mode="clip"), *(_slots(np.repeat(c[a:b], size), nodes, WORD_BITS) for c in (t.one, t.two))


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with some ``limit`` tokens; a row of more is a run of its own."""
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield at, len(sizes)


def _cuts(n: int, size: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + size)) for a in range(0, n, size))


def count_bits(vocabulary: Vocabulary, t: Tokens, into: np.ndarray) -> None:
    """Add the code bits of tokens to ``into``: contexts x (slots x 2)."""
    for a, b in _cuts(len(t.leaf), 10 * PIECE):
        _, _, bits, *slots = vocabulary.coded(t, a, b)
        for k, s in enumerate(slots):
            into[k] += np.bincount(s * np.uint32(2) + bits.view(np.uint8), minlength=into.shape[1]).astype(np.int32)


def word_inputs(vocabulary: Vocabulary, predictors: Predictors, nodes, one, two, less=None) -> tuple[list[np.ndarray], np.ndarray]:
    """Mixer inputs and gates of code bits: the node's share, and what both contexts predict; gated by how sure these are."""
    (a, sure_a), (b, sure_b) = predictors.at(0, one, less), predictors.at(1, two, less)
    return [vocabulary.shares.take(nodes, mode="clip"), a, b], sure_a * np.uint8(5) + sure_b


WORD_GATES, BYTE_GATES, BYTE_ORDERS = 25, 200, 4


def spelled(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the bits of words, a space behind each: the word's number, the byte's partial value, the bit's place, the bit, and a mixed context for each order."""
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    size = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    contexts, h = [], np.zeros(len(data), np.uint64)
    for order in range(1, BYTE_ORDERS + 1):
        previous = np.zeros(len(data), np.uint64)
        previous[order:] = data[:-order]
        h = h * np.uint64(257) + np.where(inside >= order, previous + np.uint64(1), np.uint64(0))
        contexts.append(((h * _K1 + np.uint64(order) * _K3) >> np.uint64(32)).astype(np.uint32))
    place = np.arange(8, dtype=np.uint8)
    bits = (data[:, None] >> (7 - place) & 1).astype(np.int8).ravel()
    partial = ((data[:, None].astype(np.uint16) | 256) >> (8 - place)).ravel()
    return np.repeat(word, 8), partial, np.tile(place, len(data)), bits, [np.repeat(c, 8) for c in contexts]


def count_spelling(words: list[bytes], into: np.ndarray) -> None:
    for at in range(0, len(words), 20_000):
        _, partial, _, bits, contexts = spelled(words[at : at + 20_000])
        for k, c in enumerate(contexts):
            into[k] += np.bincount(_slots(c, partial, BYTE_BITS) * np.uint32(2) + bits.view(np.uint8), minlength=into.shape[1]).astype(np.int32)


def byte_inputs(predictors: Predictors, partial, place, contexts, less=None) -> tuple[list[np.ndarray], np.ndarray]:
    found = [predictors.at(k, _slots(c, partial, BYTE_BITS), less) for k, c in enumerate(contexts)]
    return [x for x, _ in found], place * np.uint8(25) + found[2][1] * np.uint8(5) + found[3][1]


def _blocks(sizes: np.ndarray, done: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lane and order of the bits of texts of these sizes, so that first blocks come first, then second blocks, and so on; and where each round ends.

    ``done`` bits of a single text have come before.
    """
    lane, size, at = np.arange(len(sizes)), np.asarray(sizes), np.cumsum(sizes) - sizes
    lanes, begins, counts, ends, block, skip = [], [], [], [0], FIRST_BLOCK, done
    while len(lane):
        n = np.minimum(size, max(0, block - skip))
        skip = max(0, skip - block)
        lanes.append(lane)
        begins.append(at)
        counts.append(n)
        ends.append(ends[-1] + int(n.sum()))
        left = size > n
        lane, size, at = lane[left], (size - n)[left], (at + n)[left]
        block = min(2 * block, LAST_BLOCK)
    counts, begins = np.concatenate([*counts, [0]]), np.concatenate([*begins, [0]])
    order = np.repeat(begins - (np.cumsum(counts) - counts), counts)
    return np.repeat(np.concatenate([*lanes, [0]]), counts), order + np.arange(len(order)), ends


@dataclass
class Model:
    vocabulary: Vocabulary
    words: Predictors
    bytes: Predictors
    word_mixer: Mixer
    byte_mixer: Mixer
    spelling: dict[bytes, float] = field(default_factory=dict)

    def spell(self, words: list[bytes]) -> list[float]:
        """Bits of each word, spelled; kept for words seen again, up to 300,000 of them."""
        known = self.spelling
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > 300_000:
            known.clear()
            new = list(dict.fromkeys(words))
        lanes, held, size = Lanes(self.byte_mixer), [], 0
        for i, w in enumerate(new):
            held.append(w)
            size += len(w) + 1
            if size > 20_000 or i == len(new) - 1:
                word, partial, place, bits, contexts = spelled(held)
                inputs, gate = byte_inputs(self.bytes, partial, place, contexts)
                cost = lanes.step(inputs, *lanes.places(gate.astype(np.intp)), bits, learn=False)
                known.update(zip(held, np.bincount(word, cost, len(held)).tolist()))
                held, size = [], 0
        return [known[w] for w in words]

    def costs(self, t: Tokens) -> np.ndarray:
        """Bits of each token's code. Each text has a lane, which starts from the fitted weights and learns along the text, block by block."""
        v, lanes, out, done = self.vocabulary, Lanes(self.word_mixer, len(t.starts)), np.zeros(len(t.leaf)), 0
        for a, b in _cuts(len(t.leaf), PIECE if len(t.starts) == 1 else max(1, len(t.leaf))):
            size, nodes, bits, one, two = v.coded(t, a, b)
            inputs, gate = word_inputs(v, self.words, nodes, one, two)
            ends = np.cumsum(size)
            total = np.diff(np.append(np.append(0, ends)[t.starts], ends[-1])) if len(t.starts) > 1 else ends[-1:]
            lane, order, rounds = _blocks(total, done)
            cost = np.empty(len(bits), np.float32)
            bits, inputs = bits.take(order), [x.take(order) for x in inputs]
            at, cell = lanes.places(gate.take(order).astype(np.intp), lane)
            for x, y in zip(rounds, rounds[1:]):
                if y > x:
                    cost[order[x:y]] = lanes.step([v[x:y] for v in inputs], at[x:y], cell[x:y], bits[x:y])
            sums = np.append(0, np.cumsum(cost, dtype=np.float64))[np.append(0, ends)]
            out[a:b] = np.diff(sums)
            done += len(bits)
        return out


def anchors(t: Tokens, cost: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts, one row for each text, anchor and block: text, anchor, block, how often, how often the anchor, and the block's cost each time.

    An anchor is a run of ANCHOR_WORDS words that its own hash picks, and its block is all that follows, to the end of the next anchor or of the text.
    """
    n = len(t.hashes)
    text = np.zeros(n, np.int32)
    text[t.starts[1:]] = 1
    text = np.cumsum(text, dtype=np.int32)
    h = np.zeros(n, np.uint64)
    for i in range(min(ANCHOR_WORDS, n)):
        h[i:] = h[i:] * _K3 + t.hashes[: n - i] * _K1
        h ^= h >> np.uint64(29)
    h *= _K2
    inside = np.arange(n) - t.starts[text]
    last = np.append(t.starts[1:], n) - 1
    picked = np.flatnonzero(((h >> np.uint64(32)) % np.uint64(ANCHOR_EVERY) == 0) & (inside >= ANCHOR_WORDS - 1) & (np.arange(n) != last[text]))
    if not len(picked):
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.int64, np.float64))
    cuts = np.unique(np.concatenate([t.starts, picked + 1]))
    place = np.arange(n) - np.repeat(cuts, np.diff(np.append(cuts, n)))
    mixed = (t.hashes ^ (place.astype(np.uint64) * _K2)) * _K1
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _K3
    follows = np.searchsorted(cuts, picked + 1)
    block, bits = np.add.reduceat(mixed, cuts)[follows], np.add.reduceat(cost, cuts)[follows]
    own, anchor = text[picked], h[picked]
    order = np.lexsort((block, anchor, own))
    own, anchor, block, bits = own[order], anchor[order], block[order], bits[order]
    first = np.append(True, (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]))
    new = first | np.append(True, block[1:] != block[:-1])
    rows = np.flatnonzero(new)
    times = np.diff(np.append(rows, len(order)))
    group = np.cumsum(first) - 1
    return own[rows].astype(np.int64), anchor[rows].view(np.int64), block[rows].view(np.int64), times, np.bincount(group)[group[rows]], bits[rows]


def _training(docs: DataFrame, folds: int, fold: int) -> Column:
    return F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, fold)


def _counted(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(h, word, n): words of training documents with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def rows(counts: pa.Table) -> pa.RecordBatch:
            words = counts.column("word").combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(_hashes(words.to_numpy(zero_copy_only=False)).view(np.int64)), words, counts.column("n").combine_chunks()], ["h", "word", "n"])

        for batch in batches:
            counts = words_in(batch.column(0))[0].value_counts()
            held.append(pa.table([counts.field(0), counts.field(1)], ["word", "n"]))
            size, ends = size + len(counts), ends + batch.num_rows
            if size > 400_000:
                held = [merged()]
                size = held[0].num_rows
                if size > 200_000:
                    yield rows(held[0])
                    held, size = [], 0
        if ends:
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"]))
            yield rows(merged())

    return docs.filter(_training(docs, folds, fold)).select("text").mapInArrow(run, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))


#: Parts of a table that are summed apart.
BLOCKS = 512


PACKED = "trained boolean, bytes long, tokens binary, rare binary, words array<binary>, block int, counts binary"


def _ended(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts end to end, each text's end behind it: the different words, which of them each token is, and how many tokens each text has."""
    words, sizes = words_in(texts)
    words = words.dictionary_encode()
    distinct = np.append(words.dictionary.to_numpy(zero_copy_only=False), np.array([END], object))
    of = np.full(len(words) + len(sizes), len(distinct) - 1, np.int32)
    of[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words.indices.to_numpy()
    return distinct, of, sizes + 1


def _packed(docs: DataFrame, vocabulary, folds: int, fold: int) -> DataFrame:
    """Texts as their tokens, so that words are looked up once: index in the vocabulary, and for the text's rare words their hashes; with these
    words themselves where they may be unseen. Besides, each task's counts of the code bits of training texts (block, counts).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, into, some, schema = vocabulary.value, np.zeros((2, 1 << (WORD_BITS + 1)), np.int32), False, None
        for batch in batches:
            trained, size = batch.column(1).to_pylist(), pc.binary_length(pc.fill_null(batch.column(2), "")).cast(pa.int64())
            distinct, of, sizes = _ended(batch.column(2))
            h, at = v.look(distinct)
            tokens, rare, words, begin = [], [], [], 0
            for i, j in _runs(sizes, 10 * PIECE):
                end = begin + int(sizes[i:j].sum())
                part = of[begin:end]
                t, own = v.tokens(h[part], at[part], sizes[i:j]), np.array(trained[i:j])
                count_bits(v, t if own.all() else t.only(np.repeat(own, sizes[i:j])), into)
                for learnt, a, n in zip(own.tolist(), t.starts.tolist(), sizes[i:j].tolist()):
                    index = t.at[a : a + n]
                    out = np.flatnonzero(index < 0)
                    if len(out):
                        other, first, index[out] = np.unique(t.hashes[a : a + n][out], return_index=True, return_inverse=True)
                        index[out] = -1 - index[out]
                        rare.append(other.tobytes())
                        words.append(None if learnt else distinct[part[a + out[first]]].tolist())
                    else:
                        rare.append(b"")
                        words.append(None)
                    tokens.append(index.tobytes())
                begin = end
            some, n = some or any(trained), batch.num_rows
            columns = [*batch.columns[:2], size, pa.array(tokens, pa.binary()), pa.array(rare, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", *(x.split()[0] for x in PACKED.split(", "))])
            schema = out.schema
            yield out
        if some:
            for k, x in enumerate(np.split(into.reshape(-1), BLOCKS)):
                yield pa.RecordBatch.from_pylist([{"block": k, "counts": x.tobytes()}], schema)

    return docs.select("doc_id", _training(docs, folds, fold).alias("trained"), "text").mapInArrow(run, f"doc_id {kind}, {PACKED}")


def _spelling_counts(types: DataFrame) -> DataFrame:
    """(block, counts): each task's counts of the spelling bits of word types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, some = np.zeros((BYTE_ORDERS, 1 << (BYTE_BITS + 1)), np.int32), False
        for batch in batches:
            some = some or batch.num_rows > 0
            count_spelling([w.as_py() for w in batch.column(0)], into)
        if some:
            for k, x in enumerate(np.split(into.reshape(-1), BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "counts"])

    return types.mapInArrow(run, "block int, counts binary")


def _summed(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of tasks' tables (block, counts), which are summed by block; the driver gets one table of the fixed ``shape``."""

    def add(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for x in f["counts"]:
                x = np.frombuffer(x, np.int32).astype(np.int64)
                total = x if total is None else total + x
        yield pd.DataFrame({"block": [key[0]], "counts": [np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()]})

    summed = rows.groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros(shape, np.int32)
    flat = out.reshape(BLOCKS, -1)
    for r in summed.toLocalIterator():
        flat[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return out


def _learned(rows: DataFrame, start: Mixer, steps) -> Mixer:
    """``start`` after one Newton step on the logistic loss of all ``rows``, gate by gate, held to ``start`` by a weak prior.

    Each task adds up gradients and second derivatives of the (inputs, gate, bits) of ``steps(batch)``, a few kilobytes whatever it reads; sums don't depend on how
    the input is split. So the mixers begin each text with weights that all training text has taught, and go on online from there.
    """
    n_inputs, gates = start.weights.shape
    pairs = [(i, j) for i in range(n_inputs) for j in range(i, n_inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros((n_inputs + len(pairs) + 1, gates)), start.weights
        for batch in batches:
            for inputs, gate, bits in steps(batch):
                if not len(bits):
                    continue
                order = np.argsort(gate, kind="stable")
                seen = np.bincount(gate, minlength=gates)
                some = np.flatnonzero(seen)
                begins = (np.cumsum(seen) - seen)[some]
                inputs, bits = [v.take(order) for v in inputs], bits.take(order)
                p = squash(_mixed(weights, inputs, np.repeat(some, seen[some])))
                error = bits - p
                p *= 1 - p
                for k, v in enumerate(inputs):
                    sums[k, some] += np.add.reduceat(error * v, begins, dtype=np.float64)
                scaled = [p * v for v in inputs]
                for k, (i, j) in enumerate(pairs):
                    sums[n_inputs + k, some] += np.add.reduceat(scaled[i] * inputs[j], begins, dtype=np.float64)
                sums[-1] += seen
        if sums.any():
            key = int.from_bytes(blake2b(sums.tobytes(), digest_size=8).digest(), "little") % BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    def add(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(x) for f in frames for x in f["sums"])
        yield pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    parts = rows.mapInArrow(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect()  # at most BLOCKS rows
    if not parts:
        return start
    sums = sum(np.frombuffer(bytes(r["sums"])) for r in sorted(parts, key=lambda r: r["part"])).reshape(-1, gates)
    slope, curve = sums[:n_inputs].T, np.zeros((gates, n_inputs, n_inputs))
    for k, (i, j) in enumerate(pairs):
        curve[:, i, j] = curve[:, j, i] = sums[n_inputs + k]
    move = np.linalg.solve(curve + 4.0 * np.eye(n_inputs), slope[:, :, None])[:, :, 0]
    return Mixer((start.weights + np.clip(move, -1, 1).T).astype(np.float32), start.refine, start.rate)


_models: dict[str, Model] = {}


def model_of(broadcast) -> Model:
    """The worker's copy of a model, so that what it has spelled is kept between tasks."""
    name = broadcast.value.vocabulary.name
    if name not in _models:
        _models.clear()
        _models[name] = broadcast.value
    return _models[name]


def _train(docs: DataFrame, counts: DataFrame, folds: int, fold: int) -> tuple[Model, DataFrame]:
    """The model, and the texts as tokens (``_packed``)."""
    spark = docs.sparkSession
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    level = F.floor(4 * F.log2("n"))
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect()  # under 256 rows
    least, held = None, 0
    for r in levels:
        held += r["c"]
        if held > MAX_COUNTED:
            break
        least = r["level"]
    top = counts.filter(level >= least).select("h", "n").toPandas() if least is not None else pd.DataFrame({"h": [], "n": []})
    vocabulary = Vocabulary.build(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total, distinct)
    shared = spark.sparkContext.broadcast(vocabulary)
    packed, types = table(_packed(docs, shared, folds, fold), "lm-tokens"), counts.select("word")
    words = Predictors.build(_summed(packed.filter("block IS NOT NULL").select("block", "counts"), (2, 1 << (WORD_BITS + 1))))
    spelling = Predictors.build(_summed(_spelling_counts(types), (BYTE_ORDERS, 1 << (BYTE_BITS + 1))))
    tables = spark.sparkContext.broadcast((words, spelling))
    texts = packed.filter("block IS NULL").drop("block", "counts")

    def word_steps(batch: pa.RecordBatch):
        v = shared.value
        for part in _parts(batch):
            t = v.unpack(*(x.to_pylist() for x in part.columns))
            for a, b in _cuts(len(t.leaf), PIECE):
                _, nodes, bits, one, two = v.coded(t, a, b)
                yield *word_inputs(v, tables.value[0], nodes, one, two, bits), bits

    def byte_steps(batch: pa.RecordBatch):
        words = batch.column(0).to_pylist()
        for at in range(0, len(words), 5000):
            _, partial, place, bits, contexts = spelled(words[at : at + 5000])
            yield *byte_inputs(tables.value[1], partial, place, contexts, bits), bits

    word_mixer = Mixer(np.tile(np.array([[0.6], [0.5], [0.3]], np.float32), (1, WORD_GATES)))
    word_mixer.weights[:, 0] = 1  # neither context seen
    byte_mixer = Mixer(np.tile(np.array([[0.1], [0.2], [0.4], [0.4]], np.float32), (1, BYTE_GATES)))
    word_mixer = _learned(texts.filter("trained").select("tokens", "rare"), word_mixer, word_steps)
    byte_mixer = _learned(types, byte_mixer, byte_steps)
    shared.destroy()
    tables.destroy()  # all sums are here
    return Model(vocabulary, words, spelling, word_mixer, byte_mixer), texts


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some PIECE tokens; a text of more is a slice of its own."""
    for a, b in _runs(pc.binary_length(batch.column("tokens")).to_numpy() // 4, PIECE):
        yield batch.slice(a, b - a)


def _matched(scored: DataFrame) -> DataFrame:
    """(row, gain): bits that a text saves, or loses, by what follows its anchors elsewhere in the training text.

    For each anchor the table of all training text knows the block that follows most often. Whether that block comes is one more binary decision: its predictor is the
    counts of that block and of others after the anchor, less what the text itself has counted, refined to the share of such
    decisions that came true over all training text. If it comes, it replaces the codes of the block's tokens.
    """
    rows = scored.select("row", "trained", F.explode(F.arrays_zip("anchor", "block", "times_block", "times_anchor", "bits")).alias("x")).select("row", "trained", "x.*")
    blocks = rows.filter("trained").groupBy("anchor", "block").agg(F.sum("times_block").alias("n"))
    after = blocks.groupBy("anchor").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("block").alias("most"))).alias("m"))
    same, own = F.col("block") == F.col("m.most"), lambda c: F.when(F.col("trained"), F.col(c)).otherwise(0)
    met = rows.join(after, "anchor").select("row", "trained", "bits", F.col("times_block").alias("times"), same.alias("same"), (F.col("m.n") - F.when(same, own("times_block")).otherwise(0)).alias("yes"), (F.col("all") - own("times_anchor")).alias("n"))
    grade = lambda c: F.least(F.floor(F.log2(c + 1)), F.lit(5)).cast("int")
    met = met.filter("yes > 0").select("row", "trained", "bits", "times", "same", grade(F.col("yes")).alias("yes"), grade(F.col("n") - F.col("yes")).alias("no"))
    met = table(met, "lm-matched")
    right = F.sum(F.when(F.col("same"), F.col("times")).otherwise(0))
    cells = met.filter("trained").groupBy("yes", "no").agg(right.alias("right"), F.sum("times").alias("of")).collect()  # at most 36 rows
    p = F.lit(0.5)
    for c in cells:
        p = F.when((F.col("yes") == c["yes"]) & (F.col("no") == c["no"]), F.lit((c["right"] + 0.5) / (c["of"] + 1))).otherwise(p)
    met = met.withColumn("p", p)
    gain = F.col("times") * F.when(F.col("same"), F.col("bits") + F.log2("p")).otherwise(F.log2(1 - F.col("p")))
    return met.groupBy("row").agg(F.sum(gain).alias("gain"))


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Training text is that of documents outside the held-out fold (crc32 of the id as text, modulo ``folds``, is ``fold``). A text is
    its words, A-Z lower-cased, and an end. Its tokens are coded by binary decisions along a Huffman tree of the MAX_LEAVES most counted words. For each,
    three predictors (the node's share, and hashed counters of the node after the last word and after the last two, counted over all training
    text) are stretched and mixed with weights that a gate picks by how much both contexts were seen; the mix is refined by an adaptive
    table. The weights are fitted to all training text (``_learned``), and weights and table learn online along each text, block by block. A word outside the
    tree is an escape, then one of the seen words by its discounted count, or unseen; an unseen word is spelled by bits of its bytes, mixed in the same way, with hashed
    contexts of 1 to 4 bytes counted over all training word types. Long contexts come from a table that grows with the training text (``_matched``).
    A training document is scored by long contexts of the others, not by its own.

    ``score`` is log10 of the probability of the text so coded, spelling of unseen words included, and ``bits_per_byte`` is the same over the text's bytes. ``base_score`` is the
    smoothed unigram score; counts of words outside the MAX_COUNTED most counted come by a join of only those words.
    Null texts count as empty: one end. Null ids are never held out and never trained on. Repeated rows are trained on and scored each. Words that tie in counts go by hash.
    Texts may be of any length: code bits are held for PIECE tokens at once. An empty table
    gives no rows; without training text every decision is even. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = table(_counted(docs, folds, fold), "lm-counts")
    model, packed = _train(docs, counts, folds, fold)
    shared = spark.sparkContext.broadcast(model)
    total, distinct = model.vocabulary.total, model.vocabulary.distinct
    norm = float(np.log10(max(1.0, total + 0.5 * (distinct + 1))))
    lists = {"rare": pa.int64(), "times": pa.int64(), "spell": pa.float64(), "anchor": pa.int64(), "block": pa.int64(), "times_block": pa.int64(), "times_anchor": pa.int64(), "bits": pa.float64()}

    def score(model: Model, part: pa.RecordBatch) -> list[pa.Array]:
        v, n, tokens, hashes = model.vocabulary, part.num_rows, part.column("tokens").to_pylist(), part.column("rare").to_pylist()
        t = v.unpack(tokens, hashes)
        cost = model.costs(t)
        text = np.repeat(np.arange(n), np.diff(np.append(t.starts, len(t.leaf))))
        known = t.at >= 0
        c = np.where(known, v.counts.take(np.maximum(t.at, 0), mode="clip"), 1) if len(v.counts) else np.ones(len(known))
        base = np.bincount(text, np.where(known, np.log10(c + 0.5), 0), n)
        cost -= np.where(known & (t.leaf == v.escape), np.log2(np.maximum(c - DISCOUNT, 0.25) / max(1, v.rest)), 0)
        size = np.array([len(x) // 8 for x in hashes])
        ends = np.cumsum(size)
        rare = np.frombuffer(b"".join(hashes), np.int64)
        times = np.bincount((np.repeat(ends - size, np.diff(np.append(t.starts, len(t.at)))) - 1 - t.at)[~known], minlength=len(rare))
        spell = np.zeros(len(rare))  # all words of training text have been seen
        for words, a, b in zip(part.column("words").to_pylist(), (ends - size).tolist(), ends.tolist()):
            if words:
                spell[a:b] = model.spell(words)
        own, *found = anchors(t, cost)
        of_rare, of_own = (pa.array(x.astype(np.int32)) for x in (np.append(0, ends), np.searchsorted(own, np.arange(n + 1))))
        columns = [pa.ListArray.from_arrays(o, pa.array(x, k)) for (o, x), k in zip([(of_rare, rare), (of_rare, times), (of_rare, spell), *((of_own, x) for x in found)], lists.values())]
        return [pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, known, n).astype(np.int64)), pa.array(base), pa.array(np.bincount(text, cost, n)), *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *score(model, part)], ["doc_id", "trained", "bytes", "n_tokens", "known", "base", "cost", *lists])

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrays = ", ".join(f"{k} array<{'double' if x == pa.float64() else 'long'}>" for k, x in lists.items())
    scored = packed.mapInArrow(run, f"doc_id {kind}, trained boolean, bytes long, n_tokens long, known long, base double, cost double, {arrays}")
    scored = table(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    shared.destroy()
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times", "spell")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"), F.col("x.spell").alias("spell"))
    found = rare.join(counts.groupBy("h").agg(F.sum("n").alias("n")), "h", "left_outer")
    n, rest = F.coalesce(F.col("n"), F.lit(0)), float(max(1, model.vocabulary.rest))
    unseen = float(np.log2(max(0.5, DISCOUNT * model.vocabulary.rest_types) / rest))
    sums = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 0.5)).alias("rare_base"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.when(n > 0, -F.log2((n - DISCOUNT) / rest)).otherwise(F.col("spell") - unseen)).alias("rare_cost"),
    )
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = scored.drop(*lists).join(sums, "row", "left_outer").join(_matched(scored), "row", "left_outer")
    bits = F.col("cost") + of("rare_cost") - of("gain")
    return out.select(
        "doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + of("rare_base") - F.col("n_tokens") * norm).alias("base_score"),
        (bits * float(-np.log10(2))).alias("score"), F.when(F.col("bytes") > 0, bits / F.col("bytes")).alias("bits_per_byte"),
    )
