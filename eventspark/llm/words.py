"""Words of a text and 64-bit hashes of words and word windows, computed over whole texts with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. Hashes are polynomials modulo 2**64 over
the bytes of a word (and over the word hashes of a window), finished by a bijective mixer.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_Q = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1 << 14)
        grow = lambda base: np.multiply.accumulate(
            np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])
        )
        _POWERS, _INVERSES = grow(_P), grow(pow(_P, -1, 1 << 64))
    return _POWERS, _INVERSES


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective finisher (a different one per ``salt``)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of the words in them."""
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word, in order (uint64)."""
    raw, start, end = spans(data)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _Q)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` hashes; of the whole sequence if there are fewer (none: no window)."""
    n = len(hashes)
    k = min(k, n)
    if not n:
        return hashes
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _Q + hashes[i : n - k + 1 + i]
    return mix(out, k)


def shingles(data: bytes, k: int = 5) -> np.ndarray:
    """The sorted set of distinct word windows of a text."""
    return np.unique(windows(word_hashes(data), k))
