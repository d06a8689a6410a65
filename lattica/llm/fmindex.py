"""An FM-index over sequences of words: a wavelet matrix over the Burrows-Wheeler transform, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` in the order of their next `depth` symbols (prefix doubling), ties by place."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while step < depth and int(rank.max(initial=0)) + 1 < n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
    return order


class Bits:
    """A vector of bits with the number of ones before any place: 64 bits a word, one running count a word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Index over symbols 0, 1, ..., where 0 ends each indexed sequence and is never searched for.

    text: all sequences, each with a 0 after it. owner: for each place of the text, the number of its sequence's owner;
    a search keeps only ranges that hold an owner below the searcher's own. depth: patterns have at most so many symbols.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int) -> None:
        self.text = text
        self.places = suffix_array(text, depth)
        before = text[self.places - 1]  # the Burrows-Wheeler transform; place 0 takes the last 0
        n_symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))]).astype(np.int64)
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (before >> shift) & 1
            level = Bits(bits)
            self.levels.append((shift, level, int(len(bits) - bits.sum())))
            before = np.concatenate([before[bits == 0], before[bits == 1]])
        # where each symbol's run begins below the lowest level
        self.begin = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        # least owner over ranges of the suffix array: tables for lengths 1, 2, 4, ...
        self.least = [owner[self.places].astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(text):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            ones = level.before(at).astype(np.int64)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before its place, by the wavelet matrix."""
        return self._down(symbol, at) - self.begin[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of symbol + pattern from those of the patterns."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + both[: len(low)], start + both[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each range; ranges must not be empty."""
        size = np.floor(np.log2(high - low)).astype(np.int64)
        out = np.empty(len(low), np.int32)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out
