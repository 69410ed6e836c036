"""An FM-index over coded words: suffix order, wavelet matrix, sampled positions.

The indexed text is a row of stretches of words (codes 1..n), a separator (code 0)
after each. Separators differ from each other in the order, so no suffix comparison
runs past its stretch, and no walk back leaves it, as stretch starts are sampled.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 is a symbol of its own."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2 + n) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        rank, width = fresh, width * 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        """text: codes in 0..symbols, the last one 0."""
        n = len(text)
        order = suffix_order(text)
        self.last = text[order - 1]                       # the transform; text[-1] is 0
        self.before = np.zeros(symbols + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.before[1:])
        start = np.append(True, text[:-1] == 0)           # stretch starts
        marked = (start | (np.arange(n) % sample == 0))[order]
        self.sampled, self.value = marked, np.where(marked, order, -1)
        self.ones, self.zeros = [], []
        column = self.last
        for level in reversed(range(max(1, int(symbols).bit_length()))):
            bit = (column >> level) & 1
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            column = np.concatenate([column[bit == 0], column[bit == 1]])

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of code[i] before row at[i] of the transform."""
        begin, end = np.zeros_like(at), at
        levels = len(self.ones)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((code >> (levels - 1 - k)) & 1).astype(bool)
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - begin

    def back(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[code] + self.rank(code, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of every phrase; phrases: codes aligned to the right, 0 before."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.last), dtype=np.int64)
        for step in range(phrases.shape[1]):
            going = np.flatnonzero((lengths > step) & (low < high))
            if not len(going):
                break
            code = phrases[going, phrases.shape[1] - 1 - step]
            low[going], high[going] = self.back(code, low[going]), self.back(code, high[going])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            rows[going] = self.back(self.last[rows[going]], rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.value[rows] + steps
