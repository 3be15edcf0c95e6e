"""FM-index over sequences of integers: suffix order, wavelet-tree ranks, backward search and sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text keep their place in the index.
SAMPLE = 32


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    # rank is the position in the order of the first suffix that ties
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    tied = np.ones(n, dtype=bool)
    sizes = np.diff(np.r_[first, n])
    tied = np.repeat(sizes > 1, sizes)
    while tied.any():
        at = np.flatnonzero(tied)  # places in the order that are not settled
        who = order[at]
        ahead = who + length
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[who] * (n + 1) + second + 1
        sort = np.argsort(key, kind="stable")
        who, key = who[sort], key[sort]
        order[at] = who
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(at)])
        rank[who] = np.repeat(at[starts], sizes)
        tied[at] = np.repeat(sizes > 1, sizes)
        length *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            counts = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(values) - int(counts[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            s, a, b = ones[start], ones[low], ones[high]
            start, low, high = np.where(bit, zeros + s, start - s), np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return low - start, high - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places, and how often each stands before its place."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at] == 1
            s, a = ones[start], ones[at]
            start, at = np.where(bit, zeros + s, start - s), np.where(bit, zeros + a, at - a)
            symbol = symbol * 2 + bit
        return symbol, at - start


class FMIndex:
    """Index of a text of symbols 1 to ``symbols`` - 1; it ends with symbol 0, which stands nowhere else."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.r_[text.astype(np.int64), 0]
        order = suffix_order(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        self.sampled = order % sample == 0
        self.slot = np.r_[0, np.cumsum(self.sampled)]
        self.position = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the order whose suffixes begin with each pattern; rows of ``patterns`` are right-aligned, all symbols known."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        for step in range(1, width + 1):
            live = np.flatnonzero((lengths >= step) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, width - step]
            a, b = self.wavelet.rank(symbol, low[live], high[live])
            low[live], high[live] = self.before[symbol] + a, self.before[symbol] + b
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in the order, by walking back to a sampled one."""
        out = np.full(len(places), -1, dtype=np.int64)
        open_, at, steps = np.arange(len(places)), places.copy(), 0
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.position[self.slot[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            if len(open_):
                symbol, count = self.wavelet.access(at)
                at = self.before[symbol] + count
            steps += 1
        return out
