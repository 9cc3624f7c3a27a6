"""Suffix arrays by induced sorting, permuted common prefixes, and suffix automata. Numpy and plain Python."""

from __future__ import annotations

import numpy as np

#: Alphabets up to here are induced bucket by bucket in numpy; the names of a recursion run over lists.
SMALL = 300


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (S); the last one, the sentinel, is."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differ = np.flatnonzero(t[:-1] != t[1:])
        nearest = differ[np.searchsorted(differ, np.arange(n - 1))]  # the sentinel differs from all: there is one
        out[:-1] = t[nearest] < t[nearest + 1]
    return out


def _deal(out: list[list[np.ndarray]], positions: np.ndarray, letters: np.ndarray) -> None:
    """Appends positions, in order, to the lists of their letters."""
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    cut = np.flatnonzero(np.diff(letters)) + 1
    for part, letter in zip(np.split(positions[order], cut), letters[np.concatenate([[0], cut])] if len(letters) else ()):
        out[letter].append(part)


def _induced(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array induced from leftmost S suffixes, given in order of their suffixes within a letter."""
    none = np.zeros(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(seeds, leftmost, t[leftmost])
    large: list[list[np.ndarray]] = [[] for _ in range(letters)]
    for c in range(letters):  # larger suffixes, from small letters up
        fresh = np.concatenate(large[c]) if large[c] else none
        large[c] = [fresh]
        while len(fresh):
            before = fresh[fresh > 0] - 1
            before = before[~small[before]]
            own = t[before]
            _deal(large, before[own > c], own[own > c])
            fresh = before[own == c]
            large[c].append(fresh)
        if seeds[c]:
            before = np.concatenate(seeds[c])
            before = before[before > 0] - 1
            before = before[~small[before]]
            _deal(large, before, t[before])
    lesser: list[list[np.ndarray]] = [[] for _ in range(letters)]
    lesser[0] = [np.array([len(t) - 1])]
    whole = [none] * letters
    for c in range(letters - 1, -1, -1):  # smaller suffixes, from large letters down, each list back to front
        fresh = np.concatenate(lesser[c]) if lesser[c] else none
        parts = [fresh]
        while len(fresh):
            before = fresh[fresh > 0] - 1
            before = before[small[before]]
            own = t[before]
            _deal(lesser, before[own < c], own[own < c])
            fresh = before[own == c]
            parts.append(fresh)
        high = np.concatenate(large[c])
        before = high[::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        _deal(lesser, before, t[before])
        whole[c] = np.concatenate([high, np.concatenate(parts)[::-1]])
    return np.concatenate(whole)


def _induced_lists(t: list[int], small: list[bool], leftmost: list[int], letters: int) -> list[int]:
    """The same for large alphabets: one pass each way over buckets that lie in one list."""
    n = len(t)
    heads = [0] * (letters + 1)
    for c in t:
        heads[c + 1] += 1
    for c in range(letters):
        heads[c + 1] += heads[c]
    order, tail = [-1] * n, heads[1:]
    for p in reversed(leftmost):
        tail[t[p]] -= 1
        order[tail[t[p]]] = p
    head = heads[:-1]
    for k in range(n):
        p = order[k] - 1
        if p >= 0 and not small[p]:
            c = t[p]
            order[head[c]] = p
            head[c] += 1
    tail = heads[1:]
    for k in range(n - 1, -1, -1):
        p = order[k] - 1
        if p >= 0 and small[p]:
            c = t[p]
            tail[c] -= 1
            order[tail[c]] = p
    return order


def _names(t: np.ndarray, small: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each substring between neighbouring leftmost S suffixes (both ends included) its dense rank.

    Letters count with their type, L before S, so no substring is a proper prefix of another. As many
    letters as fit a 64-bit number are sorted at once; then only substrings that tie are read on.
    """
    key = t.astype(np.uint64) * np.uint64(2) + small + np.uint64(1)
    bits = int(key.max()).bit_length()
    step = max(1, 63 // bits)
    stop = np.append(left[1:], len(t) - 1)
    rank = np.zeros(len(left), np.int64)
    open_, d = np.arange(len(left)), 0
    while len(open_):
        pack = np.zeros(len(open_), np.uint64)
        for j in range(d, d + step):
            at = left[open_] + j
            pack = pack << np.uint64(bits) | np.where(at <= stop[open_], key[np.minimum(at, len(t) - 1)], np.uint64(0))
        order = np.lexsort((pack, rank[open_])) if d else np.argsort(pack, kind="stable")
        who, pack, old = open_[order], pack[order], rank[open_[order]]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (pack[1:] != pack[:-1]) | (old[1:] != old[:-1])
        block = np.ones(len(who), bool)
        block[1:] = old[1:] != old[:-1]
        place = np.arange(len(who))
        # a group of ties starts at its old rank plus its place among those that had the same rank
        rank[who] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(block, place, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        d += step
        open_ = who[tied & (left[who] + d <= stop[who])]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of t, whose last value is 0 and occurs once; values are below ``letters``.

    Suffixes are classified, substrings between leftmost smaller suffixes are sorted and named, the string of
    names is sorted recursively, and an induction gives all suffixes.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.uint16 if letters <= SMALL else np.int64)
    small = _types(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if letters <= SMALL:
        induce = lambda seeds: _induced(t, small, seeds, letters)
    else:
        tl, sl = t.tolist(), small.tolist()
        induce = lambda seeds: np.array(_induced_lists(tl, sl, seeds.tolist(), letters), np.int64)
    if not len(left):  # falling letters only
        return induce(left)
    names = _names(t, small, left)
    if int(names.max()) + 1 < len(left):
        ranked = left[suffix_array(names, int(names.max()) + 1)]
    else:
        ranked = left[np.argsort(names)]
    return induce(ranked)


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, its common prefix with the suffix before it in ``order``, up to ``most``.

    All suffixes advance eight letters at a time; t holds bytes (values below 256).
    """
    n = len(t)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + most, 8), (1, 1))
    phi = np.empty(n, np.int64)
    phi[order[1:]] = order[:-1]
    phi[order[0]] = -1
    out = np.zeros(n, np.int64)
    open_ = np.flatnonzero(phi >= 0)
    packed = np.zeros(n + most, np.uint64)
    for j in range(8):
        packed |= padded[j : j + n + most].astype(np.uint64) << np.uint64(8 * j)
    del words
    d = 0
    while len(open_) and d < most:
        equal = packed[open_ + d] == packed[phi[open_] + d]
        ended = open_[~equal]
        x = packed[ended + d] ^ packed[phi[ended] + d]
        low = np.zeros(len(ended), np.int64)
        alive = np.ones(len(ended), bool)
        for j in range(8):
            alive &= (x >> np.uint64(8 * j)) & np.uint64(255) == 0
            low += alive
        out[ended] = d + low
        open_ = open_[equal]
        d += 8
    out[open_] = d
    return np.minimum(out, np.minimum(most, n - np.arange(n)))


class SuffixAutomaton:
    """Online automaton of all factors of a growing text; letters are any hashable values."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def extend(self, letters) -> None:
        nxt, link, length, last = self.next, self.link, self.length, self.last
        for c in letters:
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.last = last

    def matching(self, letters):
        """Matching statistics: for each place the longest factor that ends there and that the text holds."""
        nxt, link, length = self.next, self.link, self.length
        state = got = 0
        for c in letters:
            while state and c not in nxt[state]:
                state = link[state]
                got = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                got += 1
            else:
                got = 0
            yield got
