"""Words of text blocks and their 64-bit hashes, computed on whole byte arrays.

A word is a longest run of bytes other than space and the five controls from tab to carriage return; these bytes never
occur inside a longer UTF-8 character. Hashes are equal for equal words on every machine and in every run. Distinct
words get equal hashes with a chance of about 5e-20 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 512
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else unchanged."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; the words of document i are first[i] to first[i + 1] - 1."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * _STEP + np.uint64(1))
    some = slice(None)
    for at in range(0, LONG, 8):
        if at:
            some = np.flatnonzero((length > at) & (length <= LONG)) if at == 8 else some[length[some] > at]
            if not len(some):
                break
        words = eight[starts[some] + at] & _MASKS[np.minimum(length[some] - at, 8)]
        h[some] = mix((h[some] ^ words) * _STEP)
    for i in np.flatnonzero(length > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive values; those that begin at the last n - 1 are left out."""
    size = max(0, len(h) - n + 1)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * 0x632BE59BD9B4E019 * seed) % 2**64 | 1)
    out = np.full(size, np.uint64(seed * 2 + 1))
    for j in range(n):
        out = out * base + h[j: j + size]
    return mix(out)


def whole(h: np.ndarray, n: int) -> int:
    """One hash for a whole short sequence, as its only shingle; tagged by its length, so unlike any gram of n."""
    return int(grams(h, len(h), seed=n + len(h) + 1)[0])


def span_hashes(h: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span a[i] to e[i] - 1 of a sequence of hashes."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), np.uint64(base))])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(h), np.uint64(pow(base, -1, 2**64)))])
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
        out.append(mix((total[e] - total[a]) * inverse[a] + (e - a).astype(np.uint64)))
    return out[0], out[1]
