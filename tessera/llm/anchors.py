"""Anchors: positions of a byte string picked by its content alone, so that equal stretches have equal anchors."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER, _UPPER = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit polynomial hash of each k-gram (k >= 1): hashes of 1, 2, 4, ... bytes are doubled, and those that make up k are joined."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, have, at, base, out = data.astype(np.uint64) + np.uint64(1), 1, 0, _BASE, None
    while True:
        if k & have:
            part = power[at : at + n]
            out = part.copy() if out is None else out * np.uint64(base) + part
            at += have
        if 2 * have > k:
            break
        power = power[:-have] * np.uint64(base) + power[have:]
        base, have = base * base % (1 << 64), 2 * have
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def owners(data: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash): runs of starts of ``window``-byte stretches that one k-gram owns.

    The owner of a stretch is its k-gram of least hash (upper 32 bits), the leftmost of equals: the stretch's content alone picks it, so equal stretches have
    owners of equal content at the same place in them. hash is the owner's, 64 bits.
    """
    if len(data) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, k)
    w = window - k + 1
    low = (h & _UPPER) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
    edge = np.flatnonzero(low[1:] != low[:-1])
    first, last = np.empty(len(edge) + 1, np.int64), np.empty(len(edge) + 1, np.int64)
    first[0], first[1:], last[:-1], last[-1] = 0, edge + 1, edge, len(low) - 1
    return first, last, h[(low[first] & _LOWER).astype(np.int64)]
