"""A compressed FM-index over word sequences: suffix array, wavelet matrix, backward search.

Symbols are any unsigned integers. The index is built for one window length: besides the
Burrows-Wheeler transform it keeps where suffixes stop sharing that many words, so that a match
which is as long as the window can drop its last word while it grows by one at the front.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64)
        packed = np.packbits(np.concatenate((bits, np.zeros(n * 64 - len(bits), bool))), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """A wavelet matrix over symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for k in range(self.levels - 1, -1, -1):
            ones = (symbols >> k & 1).astype(bool)
            self.bits.append(Bits(ones))
            self.zeros.append(len(symbols) - int(np.count_nonzero(ones)))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Position, in the last level's order, that follows the occurrences of symbol among the first i."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            r = bits.rank(i)
            i = np.where(one, zeros + r, i - r)
        return i


class FMIndex:
    """Index of sequences laid end to end. words: all words; lengths: words of each sequence;
    weights: how often each sequence stands in the data."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int):
        self.window, self.lengths = window, lengths
        s, n = len(lengths), len(words) + len(lengths)
        kinds, rank = np.unique(words, return_inverse=True)
        self.first = np.cumsum(lengths + 1) - lengths - 1  # of each sequence in the text
        text = np.zeros(n, np.int64)  # 0 closes a sequence
        body = np.ones(n, bool)
        body[self.first + lengths] = False
        text[body] = rank + 1
        order, near = self._suffixes(text, body, s, window)
        self.text = text
        bwt = np.where(order == 0, 0, text[order - 1])
        self.wavelet = Wavelet(bwt)
        counts = np.bincount(text, minlength=len(kinds) + 1)
        every = np.arange(len(kinds) + 1)
        self.shift = (np.cumsum(counts) - counts) - self.wavelet.place(every, np.zeros(len(every), np.int64))
        self.fresh = np.flatnonzero(~near)  # positions whose suffix shares fewer than `window` words with the one before
        self.block = np.cumsum(~near) - 1
        self.fresh = np.append(self.fresh, n)
        of = np.repeat(np.arange(s), lengths + 1)
        self.mass = np.concatenate(([0], np.cumsum(weights[of[order]])))

    @staticmethod
    def _suffixes(text: np.ndarray, body: np.ndarray, s: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array by prefix doubling, and which suffixes share `window` words with the one before.
        Each closing mark sorts as a symbol of its own."""
        n = len(text)
        r = np.where(body, text - 1 + s, 0)
        r[~body] = np.arange(s)
        h, half, at = 1, None, 1
        order = np.argsort(r, kind="stable")
        while True:
            if h <= window:
                half, at = r, h
            if int(r.max(initial=0)) == n - 1 and h > 1 or h > n:
                break
            tail = np.zeros(n, np.int64)
            tail[:-h] = r[h:] + 1
            key = r * (n + 2) + tail
            order = np.argsort(key)
            sorted_ = key[order]
            r = np.empty(n, np.int64)
            r[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
            h *= 2
        a, b = order[:-1], order[1:]
        near = np.zeros(n, bool)
        rest = window - at  # two overlapping spans of `at` words cover the window
        if at * 2 >= window:
            near[1:] = (half[a] == half[b]) & (half[np.minimum(a + rest, n - 1)] == half[np.minimum(b + rest, n - 1)])
        return order, near

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after each pattern grows by a symbol at its front."""
        both = self.shift[np.concatenate((symbol, symbol))] + self.wavelet.place(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return both[: len(lo)], both[len(lo) :]

    def window_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Streams each indexed sequence through the index from its last word to its first.

        Gives, for each window of each sequence (sequences in order, windows from left to right),
        its sequence and how often the window stands in the data, weights counted.
        """
        order = np.argsort(-self.lengths, kind="stable")
        length, end = self.lengths[order], (self.first + self.lengths - 1)[order]
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        found = []
        for t in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length, -t, "left"))  # sequences with more than t words
            lo, hi = self.extend(self.text[end[:active] - t], lo[:active], hi[:active])
            if t + 1 >= self.window:
                b = self.block[lo]
                lo, hi = self.fresh[b], self.fresh[b + 1]
                found.append((order[:active], length[:active] - 1 - t, self.mass[hi] - self.mass[lo]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seq, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((start, seq))
        return seq[by], count[by]
