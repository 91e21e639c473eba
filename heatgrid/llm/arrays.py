"""Numpy helpers for Arrow batches: words, their 64-bit names, and rolling hashes of word sequences.

A batch of texts becomes one flat array of word names with offsets; every later step is a vector
operation on that array. Names depend on the word's bytes alone, so equal words have equal names in
every task.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(names: np.ndarray, k: int) -> np.ndarray:
    """Hash of names[i:i + k] for every i; shorter than names by k - 1 (empty if names is shorter than k)."""
    n = len(names) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= BASE
        out += names[j:j + n]
    return mix(out)


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Marks the starts i of the flat array whose k words lie in one text (length: words - k + 1)."""
    total = int(offsets[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for j in range(1, k):
        starts = offsets[1:-1] - j  # windows that begin j words before a text's end reach over it
        starts = starts[(starts >= 0) & (starts < n)]
        ok[starts] = False
    return ok


# --- words of a whole batch, straight from its bytes ---------------------------------------------

SLICE = 1 << 18
LONG = 1 << 16
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWERED = VALUES.copy()
LOWERED[65:91] = VALUES[97:123]
POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, once per worker."""
    if not POWERS:
        n = SLICE + LONG + 1
        for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            POWERS.append(np.cumprod(p))
    return POWERS[0], POWERS[1]


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary array without nulls."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int32, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets): the words of every text in the flat bytes; text i has words[wo[i]:wo[i + 1]]."""
    inword = table[data]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start, end = inword.copy(), inword.copy()
    start[1:] &= ~inword[:-1]
    end[:-1] &= ~inword[1:]
    start[first] = inword[first]
    end[last] = inword[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit name of each word; `lower` takes A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    table = LOWERED if lower else VALUES
    up, down = powers()
    size = ends - starts
    short = size <= LONG
    some = slice(None) if short.all() else np.flatnonzero(short)
    s, e = starts[some], ends[some]
    got = np.empty(len(s), np.uint64)
    edges = np.searchsorted(s, np.arange(0, int(s[-1]) + SLICE + 1, SLICE)) if len(s) else np.zeros(1, np.int64)
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        base = int(s[a])
        seg = table[data[base:int(e[b - 1])]]
        seg *= up[:len(seg)]
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg, out=total[1:])
        got[a:b] = (total[e[a:b] - base] - total[s[a:b] - base]) * down[s[a:b] - base]
    out[some] = got
    for i in np.flatnonzero(~short):
        word = data[starts[i]:ends[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return mix(out + size.astype(np.uint64) * BASE)


def texts_of(column, nbytes: int = 1 << 23):
    """Slices (from, to) of an Arrow binary array holding about `nbytes` bytes each, one text at least."""
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset:]
    at = 0
    while at < len(column):
        to = int(np.searchsorted(off, int(off[at]) + nbytes, side="right")) - 1
        to = min(len(column), max(at + 1, to))
        yield at, to
        at = to
