"""Anchors of fixed-length strings: which start positions share an anchor, from the bytes alone.

Every string of `width` bytes has one anchor, the leftmost least of its k-byte hashes. Equal strings have it at the same
offset, so strings can only be equal if the k bytes at their anchors are.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.RandomState(20)
_BYTE = _RNG.randint(0, 1 << 62, size=256).astype(np.uint64) * np.uint64(4) + _RNG.randint(0, 4, size=256).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xD6E8FEB86659FD93
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (BASE, BASE_2)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:]) if n > 1 else None
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class RollingHash:
    """Hashes of any byte range of a buffer from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.inverse = _powers(_INVERSE[base], n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(base, n), out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.inverse[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:-size]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def anchors(data: np.ndarray, stops: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, RollingHash]:
    """Of a buffer of documents that end at `stops`: first start, number of starts, anchor, hash of the anchor's k bytes.

    Each row is a run of neighbouring start positions of strings inside one document that have the same anchor.
    """
    rolling = RollingHash(data)
    h = rolling.windows(k)
    span = width - k + 1
    n = len(data) - width + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, h[:0], rolling
    bits = np.uint64(32)  # of a place; the same for every buffer, so that copies have equal anchors
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < span:  # minimum over a doubling stretch, then over the rest by overlap
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    anchor = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    inside = np.ones(n, dtype=bool)
    for a, b in zip(np.maximum(starts, stops - width + 1).tolist(), stops.tolist()):
        inside[a : min(b, n)] = False
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    ends = np.cumsum(inside)
    counts = np.diff(np.concatenate([ends[first] - 1, [ends[-1]]])) if len(first) else none
    return first, counts, anchor[first], h[anchor[first]], rolling
