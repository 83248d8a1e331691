"""An FM-index over word numbers: a depth-limited suffix order, its Burrows-Wheeler transform, and a wavelet matrix for ranks.

All queries are answered side by side on arrays. The suffix order is exact to ``depth`` symbols, which is all that backward
search for patterns of at most ``depth`` symbols asks of it.
"""

from __future__ import annotations

import numpy as np

#: Pattern steps are done for so many patterns at once.
_BATCH = 1 << 19


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers in the order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(symbols)
    _, ranks = np.unique(symbols, return_inverse=True)
    ranks = ranks.astype(np.int64) + 1
    order = np.argsort(ranks, kind="stable")
    step = 1
    while step < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = ranks[step:]
        pairs = ranks * (n + 2) + behind
        order = np.argsort(pairs, kind="stable")
        ordered = pairs[order]
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        if ranks[order[-1]] == n:
            break
        step *= 2
    return order


class WaveletMatrix:
    """Bit planes of a sequence, highest first, each packed into 64-bit words with running counts: rank in one pass per bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.planes, values = bits, [], values.astype(np.uint32)
        for b in range(bits - 1, -1, -1):
            ones = (values >> np.uint32(b)) & np.uint32(1)
            padded = np.zeros(-(-(len(values) + 1) // 64) * 64, np.uint8)
            padded[: len(values)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32)
            zeros = int(len(values) - ones.sum())
            self.planes.append((words, counts, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        start = np.zeros(len(symbols), np.int64)
        for i, (words, counts, zeros) in enumerate(self.planes):
            bit = ((symbols >> (self.bits - 1 - i)) & 1).astype(bool)
            start, low, high = (self._step(words, counts, zeros, bit, p) for p in (start, low, high))
        return low - start, high - start

    @staticmethod
    def _step(words, counts, zeros, bit, at):
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = counts[word] + np.bitwise_count(words[word] & mask)
        return np.where(bit, zeros + ones, at - ones)


class FMIndex:
    """Backward search over ``symbols`` (numbers from 1; 0 parts texts) for patterns of at most ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.order = suffix_order(symbols, depth)
        before = symbols[self.order - 1]  # the first suffix wraps to the last symbol, which is 0
        largest = int(symbols.max(initial=0))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))]).astype(np.int64)
        self.tree = WaveletMatrix(before, max(1, largest.bit_length()))

    def repeated(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the patterns ``symbols[s : s + length]`` that occur twice or more; else low = high.

        A pattern is given up as soon as one occurrence is left: its matching statistic with other text is below ``length``.
        """
        lows, highs = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for a in range(0, len(starts), _BATCH):
            part = starts[a : a + _BATCH]
            active = np.arange(len(part))
            low, high = np.zeros(len(part), np.int64), np.full(len(part), len(symbols), np.int64)
            for step in range(length - 1, -1, -1):
                letters = symbols[part[active] + step]
                if step == length - 1:
                    low, high = self.below[letters], self.below[letters + 1]
                else:
                    r_low, r_high = self.tree.rank(letters, low, high)
                    low, high = self.below[letters] + r_low, self.below[letters] + r_high
                more = high - low > 1
                active, low, high = active[more], low[more], high[more]
                if not len(active):
                    break
            lows[a + active], highs[a + active] = low, high
        return lows, highs
