"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix, searched backward."""

from __future__ import annotations

import numpy as np


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense order ranks of the pairs (a, b)."""
    key = a * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(key, kind="stable")
    new = np.empty(len(key), np.int64)
    new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if len(key) else key
    return new


class BitRank:
    """Bits packed into words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where the one numbered k (from 0) is: its word by the counts, its bit by halving the word."""
        at = np.searchsorted(self.before, k, side="right") - 1
        word, rest, bit = self.words[at], k - self.before[at], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << width) - 1)
            low = np.bitwise_count((word >> bit.astype(np.uint64)) & mask)
            above = rest >= low
            rest, bit = rest - low * above, bit + width * above
        return at * 64 + bit


class WaveletMatrix:
    """rank of any symbol in any prefix of a sequence, one bit of the symbol a level."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.levels = []
        rest = symbols
        for level in range(self.depth):
            bit = (rest >> (self.depth - 1 - level)) & 1
            self.levels.append(BitRank(bit.astype(np.uint8)))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix length `i` ends among the symbols sorted as on the lowest level."""
        for level, bits in enumerate(self.levels):
            ones = bits.ones(i)
            i = np.where((symbol >> (self.depth - 1 - level)) & 1 == 1, bits.zeros + ones, i - ones)
        return i


class FMIndex:
    """Index of word sequences for matches of up to `reach` words; symbol 0 ends each sequence.

    Suffixes are ordered by their first `reach` words only, equal ones by position, so a search for so many words or
    fewer is exact. What stays is the transform in a wavelet matrix, a row of bits for where the suffixes that agree in
    reach - 1 words begin, and a sample of the suffixes: the first of every interval of `reach` words that holds more
    than one, which is the earliest of them. Where it is kept, only the interval that a search ends in tells.
    """

    def __init__(self, text: np.ndarray, size: int, reach: int) -> None:
        n = len(text)
        rank, have, held = text.astype(np.int64), 1, {}
        shifted = lambda r, d: np.concatenate([r[d:], np.full(min(d, n), -1, np.int64)])[:n] + 1
        while have * 2 <= reach:
            rank, have = _ranks(rank, shifted(rank, have)), have * 2
        for length in (reach - 1, reach):
            held[length] = rank if length == have else _ranks(rank, shifted(rank, length - have)) if length > have else None
        suffixes = np.argsort(held[reach], kind="stable")
        new = lambda ranks: np.concatenate([[True], ranks[suffixes][1:] != ranks[suffixes][:-1]])
        self.begins = BitRank(np.concatenate([new(held[reach - 1]), [True]]).astype(np.uint8))
        head = new(held[reach])
        several = head & ~np.concatenate([head[1:], [True]])
        self.sampled, self.sample = BitRank(several.astype(np.uint8)), suffixes[several].astype(np.int32)
        self.tree = WaveletMatrix(text[suffixes - 1], size)
        counts = np.bincount(text, minlength=size)
        every = np.arange(size)
        self.offset = np.concatenate([[0], np.cumsum(counts)[:-1]]) - self.tree.down(every, np.zeros(size, np.int64))
        self.n = n

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffixes that begin with `symbol` followed by the matches low to high."""
        down = self.tree.down(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + self.offset[np.concatenate([symbol, symbol])]
        return down[: len(symbol)], down[len(symbol) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last word of matches of `reach` words given up: all suffixes that agree in the others."""
        group = self.begins.ones(low + 1)
        ends = self.begins.place(np.concatenate([group - 1, group]))
        return ends[: len(low)], ends[len(low) :]

    def earliest(self, low: np.ndarray) -> np.ndarray:
        """The earliest of several matches of `reach` words, whose interval begins at low."""
        return self.sample[self.sampled.ones(low)]


def matching_statistics(index: FMIndex, text: np.ndarray, starts: np.ndarray, windows: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window position, number of matches, whether one is earlier) for each window of `reach` words of the indexed sequences.

    Both come from the interval that the backward search of the window ends in: its length, and its earliest position.

    All sequences are searched side by side, from their last window to their first. A sequence is
    part of the index, so its matching statistics never fall below `reach`: each step gives up the
    last word and goes one word to the left.
    """
    at = starts + windows - 1
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    for k in range(reach - 1, -1, -1):
        low, high = index.extend(text[at + k], low, high)
    places, lows, sizes = [], [], []
    while True:
        places.append(at)
        lows.append(low)
        sizes.append(high - low)
        more = at > starts
        if not more.any():
            break
        at, starts, low = at[more] - 1, starts[more], low[more]
        low, high = index.extend(text[at], *index.shorten(low))
    at, low, sizes = np.concatenate(places), np.concatenate(lows), np.concatenate(sizes)
    earlier, several = np.zeros(len(at), bool), sizes > 1
    earlier[several] = index.earliest(low[several]) < at[several]
    return at, sizes, earlier
