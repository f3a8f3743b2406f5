"""64-bit hashes of all words of many texts at once.

The texts lie in one byte buffer.  A byte's value is multiplied by a power of an
odd base; prefix sums (modulo 2^64) give every word's sum, which the inverse
power at its start makes independent of its place.  The work goes through the
buffer in segments that end between words, so that memory follows SEGMENT and
the longest word.
"""

from __future__ import annotations

import re

import numpy as np

SEGMENT = 1 << 20
BASE = 0x5851F42D4C957F2D
_white = re.compile(rb"[ \t-\r]")
_is_white = np.zeros(256, bool)
_is_white[[*range(9, 14), 32]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


with np.errstate(over="ignore"):
    _values = spread((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        with np.errstate(over="ignore"):
            for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and the place of each text's first word (and the end)."""
    buffer = b"\n".join(texts).lower()
    out, places = [], []
    start, n = 0, len(buffer)
    while start < n:
        end = min(n, start + SEGMENT)
        if end < n:
            found = _white.search(buffer, end)
            end = found.end() if found else n
        size = end - start
        _grow(size)
        codes = np.frombuffer(buffer, np.uint8, size, start)
        inside = ~_is_white[codes]
        edges = np.diff(inside, prepend=False, append=False)
        first = np.flatnonzero(edges)
        first, last = first[::2], first[1::2]
        with np.errstate(over="ignore"):
            sums = np.empty(size + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_values[codes] * _powers[:size], out=sums[1:])
            h = (sums[last] - sums[first]) * _inverse[first]
            out.append(spread(h + (last - first).astype(np.uint64)))
        places.append(first + start)
        start = end
    hashes = np.concatenate([np.empty(0, np.uint64), *out])
    at = np.concatenate([np.empty(0, np.int64), *places])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(at, begins)
