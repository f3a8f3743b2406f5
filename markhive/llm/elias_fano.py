"""Elias-Fano coded sequences and the trie of an n-gram model's cell, both read as they are packed.

A monotone sequence of n numbers below u takes about log2(u / n) + 3 bits a
number: the low bits lie packed, the high bits as a unary bit vector with a
running count of ones for each 64 bits.  Numbers are read by selecting a one in
the vector; a number is looked for by selecting the two zeros around its high
part and halving the low bits between them.  Nothing is unpacked.

Cases: an empty sequence has no numbers and finds none; equal numbers are found
at their first place; numbers are below 2^62.
"""

from __future__ import annotations

import mmap

import numpy as np

HEADER = 3  # n, low bits, words of the high part
_one = np.uint64(1)


def pack(values: np.ndarray) -> bytes:
    """The level of a sorted array of non-negative int64: header, high bits, counts, low bits, all in 64-bit words."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
    high = (values >> low) + np.arange(n)
    # at least one zero follows the last one
    bits = np.zeros((int(high[-1]) + 1 if n else 0) // 64 * 64 + 64, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    counts = np.zeros((len(words) + 2) // 2 * 2, "<u4")
    np.cumsum(np.bitwise_count(words), out=counts[1 : len(words) + 1])
    parts = [np.array([n, low, len(words)], "<i8"), words, counts]
    if low:
        own = values.astype(np.uint64) & (_one << np.uint64(low)) - _one
        at = np.arange(n, dtype=np.int64) * low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        packed = np.zeros(n * low // 64 + 2, "<u8")
        first = np.flatnonzero(np.diff(word, prepend=-1))
        packed[word[first]] = np.bitwise_or.reduceat(own << shift, first)
        over = np.flatnonzero((at & 63) + low > 64)  # one number at most crosses the end of a word
        packed[word[over] + 1] |= own[over] >> (np.uint64(64) - shift[over])
        parts.append(packed)
    return b"".join(p.tobytes() for p in parts)


class Level:
    """A packed level inside a buffer, from byte ``at`` on."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low, words = np.frombuffer(buffer, "<i8", HEADER, at).tolist()
        at += 8 * HEADER
        self.high = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.ones = np.frombuffer(buffer, "<u4", words + 1, at)
        at += 4 * ((words + 2) // 2 * 2)
        self.packed = np.frombuffer(buffer, "<u8", self.n * self.low // 64 + 2, at) if self.low else None
        # zeros before each word, from the counts of ones
        self.zeros = (np.arange(words + 1, dtype=np.int64) << 6) - self.ones

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Places of the k-th (from 0) ones of the high part, or of its zeros if flipped."""
        word = np.searchsorted(counts, k, "right") - 1
        rest = (k - counts[word]).astype(np.int64)
        bits = self.high[word] ^ flip
        place = word << 6
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & ((_one << np.uint64(width)) - _one)).astype(np.int64)
            after = rest >= below
            rest -= np.where(after, below, 0)
            step = np.where(after, width, 0)
            place += step
            bits >>= step.astype(np.uint64)
        return place

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the i-th numbers."""
        if not self.low:
            return np.zeros(len(i), np.int64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # the next word's share is shifted in two steps, since a shift by 64 is none
        both = self.packed[word] >> shift | self.packed[word + 1] << _one << (np.uint64(63) - shift)
        return (both & (_one << np.uint64(self.low)) - _one).astype(np.int64)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        if not len(i):
            return np.empty(0, np.int64)
        return (self._select(i, self.ones, np.uint64(0)) - i) << self.low | self._lows(i)

    def search(self, wanted: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """First place of each number inside its begin..end, -1 where it is not there."""
        out = np.full(len(wanted), -1, np.int64)
        part = wanted >> self.low
        may = np.flatnonzero(part < self.zeros[-1])
        if not len(may) or not self.n:
            return out
        part, low = part[may], wanted[may] & (1 << self.low) - 1
        everything = ~np.uint64(0)
        # numbers of a high part lie between the zero that ends the part before and the one that ends it
        last = self._select(part, self.zeros, everything) - part
        before = np.maximum(part - 1, 0)
        first = np.where(part > 0, self._select(before, self.zeros, everything) - before, 0)
        first = np.maximum(first, np.broadcast_to(begin, len(wanted))[may])
        last = np.minimum(last, np.broadcast_to(end, len(wanted))[may])
        stop = last.copy()
        open_ = np.flatnonzero(first < last)
        while len(open_):
            middle = (first[open_] + last[open_]) >> 1
            less = self._lows(middle) < low[open_]
            first[open_[less]] = middle[less] + 1
            last[open_[~less]] = middle[~less]
            open_ = open_[first[open_] < last[open_]]
        inside = np.flatnonzero(first < stop)
        inside = inside[self._lows(first[inside]) == low[inside]]
        out[may[inside]] = first[inside]
        return out


def unpack(level: bytes | memoryview) -> np.ndarray:
    """All numbers of a level."""
    own = Level(level)
    return own.values(np.arange(own.n))


class Trie:
    """Two levels: contexts with pointers, and the successors of each context with their codes.

    A successor is coded relative to its context: the context's place in its
    level is the number's high part, so that one monotone sequence holds all
    successors.  A search stays inside the context's pointers.  All levels lie in
    one anonymous memory map, which goes back to the system with the trie.
    """

    BITS = 40  # of a successor

    def __init__(self, contexts: bytes, pointers: bytes, successors: bytes, codes: bytes):
        parts = (contexts, pointers, successors, codes)
        self.region = mmap.mmap(-1, max(1, sum(map(len, parts))))
        at = []
        for part in parts:
            at.append(self.region.tell())
            self.region.write(part)
        self.contexts, self.pointers, self.successors = (Level(self.region, a) for a in at[:3])
        self.codes = np.frombuffer(self.region, np.uint8, len(codes), at[3])

    @classmethod
    def build(cls, contexts: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> Trie:
        """contexts: sorted; keys: sorted (place of context << BITS | successor); codes: of the keys."""
        counts = np.bincount(keys >> cls.BITS, minlength=len(contexts))
        return cls(pack(contexts), pack(np.r_[0, np.cumsum(counts)]), pack(keys), codes.astype(np.uint8).tobytes())

    def places(self, contexts: np.ndarray) -> np.ndarray:
        """Place of each context, -1 where the trie has none."""
        return self.contexts.search(contexts, 0, self.contexts.n)

    def codes_after(self, place: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each successor of the context at its place (-1: of none); 0 where the trie has none."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero(place >= 0)
        place = place[known]
        # each context's pointers are read once where its successors come together
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        runs = np.diff(heads, append=len(place))
        begin, end = (np.repeat(self.pointers.values(place[heads] + k), runs) for k in (0, 1))
        at = self.successors.search(place << self.BITS | successor[known], begin, end)
        out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each (context, successor); 0 where the trie has none."""
        return self.codes_after(self.places(context), successor)
