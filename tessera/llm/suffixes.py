"""Suffix order of a byte string with common prefixes, by induced sorting with disk-backed queues."""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queue contents held in memory before they go to a temporary file, which closes with the sort.
QUEUE_BYTES = 256 << 20
#: An end, a separator, and 256 bytes.
SYMBOLS = 258
#: By n: the first n bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Queues:
    """One first-in, first-out queue of positions for each first symbol. Taken symbol by symbol, they are the priority queue of induced
    sorting: positions come out by (symbol, order of the suffix behind). Over ``limit`` bytes, contents move to a file.
    """

    def __init__(self, symbols: int, limit: int = QUEUE_BYTES):
        self.held: list[list] = [[] for _ in range(symbols)]
        self.limit, self.bytes, self.file = limit, 0, None

    def put(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Append ``positions``, in their order, each to the queue of its symbol."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, mine = symbols[order], positions[order]
        cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(mine)]
        for symbol, a, b in zip(symbols[cuts[:-1]].tolist(), cuts, cuts[1:]):
            self.held[symbol].append(mine[a:b])
        self.bytes += positions.nbytes
        if self.bytes > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for queue in self.held:
                for i, x in enumerate(queue):
                    if isinstance(x, np.ndarray):
                        queue[i] = (self.file.seek(0, 2), len(x))
                        self.file.write(x.tobytes())
            self.bytes = 0

    def take(self, symbol: int) -> np.ndarray:
        out = []
        for x in self.held[symbol]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(8 * x[1]), np.int64)
            else:
                self.bytes -= x.nbytes
            out.append(x)
        self.held[symbol] = []
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _induce(s: np.ndarray, small: np.ndarray, stars: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the order of the star suffixes: first those that are larger than the next, symbols upwards, then the others downwards.

    In a symbol's bucket each suffix brings the one before it into the bucket of its own symbol, behind what is there. Suffixes that stay in the bucket
    (runs of one symbol) come in the next pass over it.
    """
    stars_of = np.split(stars, np.searchsorted(s[stars], np.arange(1, symbols)))
    queues, large = Queues(symbols), []
    for c in range(symbols):
        mine, new = [], queues.take(c)
        while len(new):
            mine.append(new)
            before = new[new > 0] - 1
            before = before[~small[before]]
            stay = s[before] == c
            queues.put(s[before[~stay]], before[~stay])
            new = before[stay]
        before = stars_of[c][stars_of[c] > 0] - 1
        queues.put(s[before], before)
        large.append(np.concatenate(mine) if mine else np.empty(0, np.int64))
    queues, parts = Queues(symbols), []
    last = len(s) - 1
    for c in range(symbols - 1, -1, -1):
        mine, new = [], queues.take(c)
        while len(new):
            mine.append(new)
            before = new[new > 0] - 1
            before = before[small[before]]
            stay = s[before] == c
            queues.put(s[before[~stay]], before[~stay])
            new = before[stay]
        if not c:  # the end; no suffix brings it
            mine.append(np.array([last]))
        own = large[c][::-1]
        before = own[own > 0] - 1
        before = before[small[before]]
        queues.put(s[before], before)
        parts += [np.concatenate(mine) if mine else np.empty(0, np.int64), own]
    return np.concatenate(parts)[::-1]


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of ``data`` (symbols 0 to 256, ending in 0), ordered by their first ``depth`` symbols at least."""
    s = np.append(data.astype(np.int16) + np.int16(1), np.int16(0))  # an end that is less than all, and alone; numpy sorts two bytes by radix
    n = len(s)
    step = np.diff(s, append=s[-1])
    rises = np.flatnonzero(step)  # a run of equal symbols has the type of the step behind it
    small = np.ones(n, bool)
    if len(rises):
        small[: rises[-1] + 1] = np.repeat(step[rises] > 0, np.diff(rises, prepend=-1))
    star = np.zeros(n, bool)
    star[1:] = small[1:] & ~small[:-1]
    stars = np.flatnonzero(star)
    if len(stars) > 1:
        first = stars[np.argsort(s[stars], kind="stable")]
        by_piece = _induce(s, small, first, SYMBOLS)
        by_piece = by_piece[star[by_piece]]  # stars by the piece up to the next star
        names = _names(s, stars, by_piece)
        stars = stars[_by_names(names, depth)]
    return _induce(s, small, stars, SYMBOLS)[1:]


def _names(s: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each star's piece, equal for equal pieces; ``order`` has the stars by piece."""
    index = np.zeros(len(s), np.int64)
    index[stars] = np.arange(len(stars))
    ends = np.append(stars[1:], len(s) - 1)
    at = index[order]
    size = ends[at] - stars[at] + 1
    four = np.ndarray(len(s), "<u8", np.append(s, np.zeros(3, s.dtype)).astype("<i2"), strides=(2,))  # symbols from each position on
    new = np.ones(len(order), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    i = 0
    while len(same):  # those equal so far
        left = size[same] - i
        equal = (four[order[same] + i] ^ four[order[same - 1] + i]) & FIRST[2 * np.minimum(left, 4)] == 0
        new[same[equal & (left <= 4)]] = False
        same = same[equal & (left > 4)]
        i += 4
    names = np.empty(len(order), np.int64)
    names[at] = np.cumsum(new) - 1
    return names


def _by_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the sequence's suffixes, ties by position: the recursion, whose alphabet is too large for buckets, puts ranks together instead, two or more at once, until a rank spans ``depth`` symbols (each piece has two at least).

    Ranks and the position are sorted as the bits of one number where they fit.
    """
    rank, span, n = names, 1, len(names)
    place = (n - 1).bit_length()
    order = None
    while True:
        distinct = int(rank.max()) + 1
        if distinct == n or 2 * span > depth + 2 or span >= n:
            return np.argsort(rank, kind="stable") if order is None else order
        bits = distinct.bit_length()
        many = (64 - place) // bits
        if many > 1:
            one = (rank + 1).astype(np.uint64)
            key = one.copy()
            for at in range(span, many * span, span):
                key <<= np.uint64(bits)
                key[: max(0, n - at)] |= one[at:]
            key = key << np.uint64(place) | np.arange(n, dtype=np.uint64)
            key.sort()
            order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
            key >>= np.uint64(place)
        else:
            many = 2
            key = rank * (n + 1)
            key[:-span] += rank[span:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        span *= many


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, how many symbols it shares with the suffix before it in ``order``, up to the next 0.

    A position whose predecessor has the same symbol in front shares one symbol less than the position in front shares. Only the others are compared, eight symbols at a time, all at once.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    inherits = np.zeros(n, bool)
    inherits[1:] = (before[1:] > 0) & (s[before[1:] - 1] == s[:-1]) & (s[:-1] != 0) & (before[:-1] == before[1:] - 1)
    heads = np.flatnonzero(~inherits & (before >= 0))
    length = np.zeros(n, np.int64)
    padded = (np.append(s, np.zeros(15, s.dtype)) - 1 & 255).astype(np.uint8)
    eight = np.ndarray(n + 8, "<u8", padded, strides=(1,))  # symbols from each position on
    zero = np.flatnonzero(s == 0)
    left = np.full(n, n)  # symbols up to the next 0
    if len(zero):
        left[: zero[-1] + 1] = np.repeat(zero, np.diff(zero, prepend=-1))
    left -= i
    live, most, k = heads, np.minimum(left[heads], left[before[heads]]), 0
    while len(live):
        other = eight[live + k] ^ eight[before[live] + k]
        same = (other == 0) & (k + 8 <= most)
        ended = ~same
        unlike = other[ended]
        length[live[ended]] = np.minimum(most[ended], k + sum((unlike & FIRST[j] == 0).astype(np.int64) for j in range(1, 9)))
        live, most, k = live[same], most[same], k + 8
    head = np.maximum.accumulate(np.where(inherits, 0, i))
    return np.where(inherits, np.maximum(0, length[head] - (i - head)), length)
