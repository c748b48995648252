"""FM-index over sequences of integers, in arrays: backward search of many patterns side by side.

The Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with one count per 64 bits. Suffixes
are sorted by their first 2^k symbols only, at least one more than the window in question; that is all
a backward search of such patterns needs. Matching statistics are capped at the window's length.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int32)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, _Bits, int]] = []
        values = values.astype(np.uint32)
        walk = np.zeros(symbols, dtype=np.int64)
        names = np.arange(symbols, dtype=np.uint32)
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bits = ((values >> shift) & 1).astype(np.uint8)
            level = (shift, _Bits(bits), int(len(bits) - bits.sum()))
            self.levels.append(level)
            walk = self._step(level, names, walk)
            ones = bits.astype(bool)
            values = np.concatenate([values[~ones], values[ones]])
        self.origin = walk  # where each symbol's run starts in the last level

    @staticmethod
    def _step(level, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        shift, bits, zeros = level
        ones = bits.rank(at)
        return np.where((symbols >> shift) & 1, zeros + ones, at - ones)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        for level in self.levels:
            at = self._step(level, symbols, at)
        return at - self.origin[symbols]


class FMIndex:
    """Index of ``texts``, integer arrays of symbols 0 to ``symbols`` - 1, for windows of ``window`` symbols."""

    def __init__(self, texts: list[np.ndarray], symbols: int, window: int) -> None:
        self.window, self.symbols = window, symbols + 1
        sizes = np.array([len(text) + 1 for text in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        joined = np.zeros(int(sizes.sum()), dtype=np.int32)  # 0 parts the texts
        for start, text in zip(self.starts, texts):
            joined[start : start + len(text)] = text
            joined[start : start + len(text)] += 1
        self.size = len(joined)
        ranks = self._sort(joined)
        before = joined[self.rows - 1]  # row of suffix 0 gets the last separator
        counts = np.bincount(before, minlength=self.symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.wavelet = WaveletMatrix(before, self.symbols)
        self._common(ranks)

    def _sort(self, joined: np.ndarray) -> list[np.ndarray]:
        """Sets ``rows`` (suffixes in order) and gives, for depths 1, 2, 4 ..., the ranks of suffixes by their first symbols."""
        rank, depth, ranks = joined.astype(np.int64), 1, []
        while True:
            ranks.append(np.append(rank, -1).astype(np.int32))
            if depth > self.window:
                break
            after = np.full(self.size, -1, dtype=np.int64)
            after[: max(0, self.size - depth)] = rank[depth:]
            key = rank * (int(rank.max()) + 2) + after + 1
            self.rows = np.argsort(key, kind="stable")
            ordered = key[self.rows]
            rank = np.empty(self.size, dtype=np.int64)
            rank[self.rows] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            depth *= 2
        return ranks

    def _common(self, ranks: list[np.ndarray]) -> None:
        """Length of the prefix that each row shares with the one before, up to the window, and rows of equal windows."""
        shared = np.zeros(self.size, dtype=np.int64)
        upper, lower = self.rows[:-1], self.rows[1:]
        for power in reversed(range(len(ranks) - 1)):
            rank = ranks[power]
            a, b = np.minimum(upper + shared[1:], self.size), np.minimum(lower + shared[1:], self.size)
            shared[1:] += (rank[a] == rank[b]) * (1 << power)
        shared[0] = -1
        self.shared = np.append(np.minimum(shared, self.window), -1).astype(np.int16)
        fresh = self.shared[:-1] < self.window
        self.kind = np.cumsum(fresh) - 1
        self.kind_start = np.flatnonzero(fresh)
        self.kind_end = np.append(self.kind_start[1:], self.size)
        self.lows = None

    def _table(self) -> list[np.ndarray]:
        """Minima of ``shared`` over spans of 1, 2, 4 ... rows; only patterns that are not in the index need it."""
        if self.lows is None:
            self.lows = [self.shared]
            while (1 << len(self.lows)) <= len(self.shared):
                last, span = self.lows[-1], 1 << (len(self.lows) - 1)
                self.lows.append(np.minimum(last[:-span], last[span:]))
        return self.lows

    def _parents(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval of each one, and the length of the prefix that its rows share."""
        length = np.maximum(self.shared[low], self.shared[high]).astype(np.int64)
        low, high, table = low.copy(), high.copy(), self._table()
        for power in reversed(range(len(table))):
            span, lows = 1 << power, table[power]
            at = low - span + 1
            go = (at >= 0) & (lows[np.maximum(at, 0)] >= length) & (low >= span)
            low = np.where(go, low - span, low)
            fits = high + span <= len(self.shared)
            go = fits & (lows[np.minimum(high, len(lows) - 1)] >= length)
            high = np.where(go, high + span, high)
        return low, high, np.maximum(length, 0)

    def windows(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each start in each text the kind of its window in the index, or -1 where it doesn't occur.

        Texts are read from their ends. A pattern grows to the left while it occurs; one symbol beyond the window, it is cut
        on the right again; where it doesn't occur, it is cut to the longest prefix that other rows share.
        A symbol outside the alphabet is given as -1.
        """
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
        if not len(sizes) or not sizes[0]:
            return [np.full(0, -1) for _ in texts]
        grid = np.full((int(sizes[0]), len(order)), -2, dtype=np.int64)
        for lane, i in enumerate(order):
            grid[: len(texts[i]), lane] = texts[i][::-1]
        found = np.full(grid.shape, -1, dtype=np.int64)
        low = np.zeros(len(order), dtype=np.int64)
        high = np.full(len(order), self.size, dtype=np.int64)
        length = np.zeros(len(order), dtype=np.int64)
        for step, row in enumerate(grid):
            lanes = np.arange(int(np.searchsorted(-sizes, -step, "left")))
            unknown = lanes[row[lanes] < 0]
            low[unknown], high[unknown], length[unknown] = 0, self.size, 0
            lanes = lanes[row[lanes] >= 0]
            while len(lanes):
                symbols = row[lanes] + 1
                base = self.first[symbols]
                a = base + self.wavelet.rank(symbols, low[lanes])
                b = base + self.wavelet.rank(symbols, high[lanes])
                there = a < b
                some = lanes[there]
                low[some], high[some] = a[there], b[there]
                length[some] += 1
                long = some[length[some] > self.window]
                kinds = self.kind[low[long]]
                low[long], high[long], length[long] = self.kind_start[kinds], self.kind_end[kinds], self.window
                full = some[length[some] == self.window]
                found[step, full] = self.kind[low[full]]
                lanes = lanes[~there]
                lanes = lanes[length[lanes] > 0]
                if len(lanes):
                    low[lanes], high[lanes], length[lanes] = self._parents(low[lanes], high[lanes])
        out: list[np.ndarray] = [np.full(0, -1)] * len(texts)
        for lane, i in enumerate(order):
            out[i] = found[: len(texts[i]), lane][::-1]
        return out

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """The smallest of the texts' ``values`` by kind of window."""
        text = np.searchsorted(self.starts, self.rows, "right") - 1
        return np.minimum.reduceat(values[text], self.kind_start)
