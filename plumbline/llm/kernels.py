"""Vectorised text kernels: words, their 64-bit hashes, sets of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_GOLD = U64(_ODD)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: What a byte counts as when words are hashed: itself, or a-z for A-Z.
RAW_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES = RAW_BYTES.copy()
LOWER_BYTES[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Spans of more bytes than this are hashed one by one.
LONG = 512
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (zeros beyond the end) as one number, and one more of zeros."""
    padded = np.concatenate((data, np.zeros(9, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], mixed eight bytes at a time: no algebra makes different bytes meet, only chance."""
    start, left = np.asarray(start, np.int64), np.asarray(end, np.int64) - np.asarray(start, np.int64)
    out = mix(left.astype(U64) * _GOLD)
    view, todo, step = eights(data), np.flatnonzero((left > 0) & (left <= LONG)), 0
    while len(todo):
        rest = left[todo] - step
        out[todo] = mix(out[todo] * _GOLD + (view[start[todo] + step] & _MASK[np.minimum(rest, 8)]))
        step += 8
        todo = todo[rest > 8]
    if (long := np.flatnonzero(left > LONG)).size:
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(start[long].tolist(), left[long].tolist(), strict=True)]
    return out


def fixed_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of data[i : i + k] for every i, by doubling: each step mixes two neighbours of half the size."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    have = min(k, 8)
    h = mix((eights(data)[: len(data) - have + 1] & _MASK[have]) + U64(k))
    while have < k:
        step = min(have, k - have)
        h = mix(h[:-step] * _GOLD + h[step:])
        have += step
    return h


#: Bytes that are no letter and no digit; bytes of characters beyond ASCII count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False


def words(data: np.ndarray, starts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't space, and for each text the number of its first word (with an end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = ~space[data]
    begins = np.empty(n, bool)
    begins[0] = True
    np.logical_not(inside[:-1], out=begins[1:])
    begins[starts[:-1][starts[:-1] < n]] = True
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = begins[1:] | ~inside[1:]
    ws = np.flatnonzero(begins & inside)
    we = np.flatnonzero(ends & inside) + 1
    return ws, we, np.searchsorted(ws, starts)


def word_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray = LOWER_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each word, A-Z lowered, and for each text the number of its first word."""
    ws, we, first = words(data, starts)
    if not len(ws):
        return np.zeros(0, U64), first
    return span_hashes(table[data], ws, we), first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words count as one shingle, no words as none."""
    total = len(hashes)
    if total >= k:
        run = hashes[: total - k + 1].copy()
        for j in range(1, k):
            run *= U64(0xC2B2AE3D27D4EB4F)
            run += hashes[j : total - k + 1 + j]
        run = mix(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(run[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = U64(b - a)
            for x in hashes[a:b]:
                h = U64((int(h) * 0xC2B2AE3D27D4EB4F + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h ^ U64(0x5851F42D4C957F2D)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
