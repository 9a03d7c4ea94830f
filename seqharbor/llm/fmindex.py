"""A compressed full-text index of one shard: suffix order, wavelet matrix, sampled positions.

All queries are answered for whole arrays of patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class BitRank:
    """Packed bits with running counts per 64: the number of ones before a position."""

    def __init__(self, bits: np.ndarray):
        words = -(-(len(bits) + 1) // 64)
        padded = np.zeros(words * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << inside) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol below ``sigma`` in any prefix of a sequence."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        row = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level) & 1
            self.levels.append(BitRank(bit.astype(np.uint8)))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        everything = np.arange(sigma, dtype=np.int64)
        self.base = np.zeros(sigma, dtype=np.int64)
        self.base = self._descend(everything, np.zeros(sigma, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.base[symbol]

    def symbol_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at).astype(np.int64)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at - self.base[symbol]


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions in suffix order; the last symbol must be 0 and occur nowhere else.

    Ranks by a few symbols first, then by twice as many in each round; a round sorts only the
    suffixes that are still tied.
    """
    n = len(text)
    width = max(1, int(sigma - 1).bit_length())
    seen = max(1, min(62 // width, n))
    key = np.zeros(n, dtype=np.int64)
    for j in range(seen):
        key <<= width
        key[: n - j] |= text[j:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~first | ~np.r_[first[1:], True])
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[at + seen]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        first = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~first | ~np.r_[first[1:], True]]
        seen *= 2
    return order


class FMIndex:
    """``text`` holds symbols from 1 to ``sigma`` - 1; it is closed by a 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        closed = np.r_[text.astype(np.int64), 0]
        order = suffix_order(closed, sigma)
        self.size, self.sigma = len(closed), sigma
        self.tree = WaveletMatrix(closed[order - 1], sigma)
        self.starts = np.r_[0, np.cumsum(np.bincount(closed, minlength=sigma))]
        chosen = order % sample == 0
        self.marks, self.samples = BitRank(chosen.astype(np.uint8)), order[chosen]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with one more symbol in front."""
        base = self.starts[symbol]
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[: len(symbol)], base + both[len(symbol):]

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a matrix with one pattern in each row: those that occur ``least`` times, with their row
        ranges. A pattern is given up at the suffix that is rarer."""
        alive = np.arange(len(patterns))
        symbol = patterns[:, -1]
        low, high = self.starts[symbol], self.starts[symbol + 1]
        for j in range(patterns.shape[1] - 1, -1, -1):
            if j < patterns.shape[1] - 1:
                low, high = self.extend(patterns[alive, j], low, high)
            some = high - low >= least
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled position."""
        found = np.zeros(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            done = self.marks.get(at).astype(bool)
            found[open_[done]] = self.samples[self.marks.rank(at[done])] + steps
            open_, at = open_[~done], at[~done]
            symbol, rank = self.tree.symbol_rank(at)
            at = self.starts[symbol] + rank
            steps += 1
        return found
