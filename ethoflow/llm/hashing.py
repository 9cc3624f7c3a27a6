"""Words, shingles and 64-bit hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (public domain constants)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_table = np.zeros(0, U)


def coefficients(n: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit numbers."""
    global _table
    if len(_table) < n:
        _table = mix(np.arange(1, max(n, 1024) * 2 + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    return _table[:n]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values separate words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE = separators((0x09, 0x0D), (0x20, 0x20))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """The words of some texts: byte range, text number and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, white: np.ndarray = WHITE):
        self.n_texts = len(offsets) - 1
        if lower:
            data = _LOWER[data]
        gap = white[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:], after[:-1] = gap[:-1], gap[1:]
            before |= edge[:-1]
            after |= edge[1:]
        inside = ~gap
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        if len(self.start):
            length = self.end - self.start
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            rank = np.arange(int(length.sum())) - np.repeat(first, length)
            weighed = (data[inside].astype(U) + U(1)) * coefficients(int(length.max()))[rank]
            self.hash = mix(np.add.reduceat(weighed, first) + length.astype(U))
        else:
            self.hash = np.zeros(0, U)
        #: words before each text, and in all
        self.first = np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def runs(self, k: int) -> np.ndarray:
        """Hashes of k neighbouring words, from each word on (runs that leave the text included)."""
        n = len(self.hash) - k + 1
        total = np.zeros(max(n, 0), U)
        for j, c in enumerate(coefficients(k)):
            total += self.hash[j : j + max(n, 0)] * c
        return mix(total)

    def shingle_sets(self, k: int):
        """For each text its distinct k-word shingles as sorted hashes; fewer words make one shingle."""
        runs, c = self.runs(k), coefficients(k)
        for t in range(self.n_texts):
            low, high = int(self.first[t]), int(self.first[t + 1])
            if high - low >= k:
                yield np.unique(runs[low : high - k + 1])
            elif high > low:
                yield mix(((self.hash[low:high] * c[: high - low]).sum(dtype=U) + U(high - low)).reshape(1))
            else:
                yield np.zeros(0, U)
