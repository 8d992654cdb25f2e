"""Words of UTF-8 bytes as arrays: places and hashes, without a Python loop."""

from __future__ import annotations

import numpy as np
import xxhash

#: 0 white space (0x20, 0x09-0x0D), 1 letters, digits and all beyond ASCII, 2 other characters.
CLASS = np.full(256, 2, np.uint8)
CLASS[[32, 9, 10, 11, 12, 13]] = 0
CLASS[48:58] = CLASS[65:91] = CLASS[97:123] = 1
CLASS[128:] = 1
WORD = np.where(CLASS == 0, 0, 1).astype(np.uint8)
_LONGEST = 256


def _powers(base: int) -> np.ndarray:
    out = np.empty(_LONGEST, np.uint64)
    p = 1
    for i in range(_LONGEST):
        out[i] = p
        p = p * base & (1 << 64) - 1
    return out


_P = _powers(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: bytes, classes: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class but class 0."""
    c = classes[np.frombuffer(data, np.uint8)]
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(c)]
    own = c[cut] != 0 if len(c) else np.zeros(0, bool)
    return cut[own], end[own]


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: of its bytes and length, alike on every machine."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64)
    a = np.frombuffer(data, np.uint8)
    capped = np.minimum(n, _LONGEST)
    first = np.cumsum(capped) - capped
    inside = np.arange(int(capped.sum())) - np.repeat(first, capped)
    h = np.add.reduceat((a[np.repeat(starts, capped) + inside].astype(np.uint64) + np.uint64(1)) * _P[inside], first)
    for k in np.flatnonzero(n > _LONGEST):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], 1)
    return mix(h + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
