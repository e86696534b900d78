"""An FM-index over the words of one shard of texts, in numpy.

Words are numbered; the shard is their sequence with an end mark after each text. The suffix array is sorted by
prefix doubling, where a round sorts only what is still tied. Its last column (BWT) is kept in a wavelet matrix,
whose rank answers drive backward search, and every SAMPLE-th text position of the suffix array is kept, from
which the others are found by steps of the LF-mapping.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``words`` in order. The last word must occur nowhere else and be the least."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    head = np.r_[True, np.diff(rank[order]) != 0]
    starts = np.flatnonzero(head)
    rank[order] = starts[np.cumsum(head) - 1]  # a group's rank is the place where it begins
    step = 1
    tied = _tied(head)
    while len(tied):
        at = order[tied]
        following = at + step
        # Beyond the end there is nothing: such a suffix comes first in its group.
        second = np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new = np.r_[True, np.diff(key) != 0]
        rank[at] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        head[tied] = new
        tied = _tied(head)
        step *= 2
    return order


def _tied(head: np.ndarray) -> np.ndarray:
    """Places in groups of more than one, of the groups that begin where ``head`` is set."""
    alone = head & np.r_[head[1:], True]
    return np.flatnonzero(~alone)


class WaveletMatrix:
    """Rank over a sequence of numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        rest = values.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = ((rest >> np.uint32(level)) & np.uint32(1)).astype(bool)
            before = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(rest) - int(before[-1]))
            rest = np.concatenate([rest[~bit], rest[bit]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``value`` occurs before the place ``at``."""
        start, end = np.zeros_like(at), at.copy()
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (value >> (self.levels - 1 - depth)) & 1
            s, e = ones[start], ones[end]
            start, end = np.where(bit, zeros + s, start - s), np.where(bit, zeros + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it occurs before it."""
        value, start, here = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[here + 1] - ones[here]
            value = value * 2 + bit
            s, e = ones[start], ones[here]
            start, here = np.where(bit, zeros + s, start - s), np.where(bit, zeros + e, here - e)
        return value, here - start


class FMIndex:
    """Counts and locates word phrases in a shard. ``words`` are numbers from 2 on; 1 ends each text."""

    def __init__(self, words: np.ndarray) -> None:
        text = np.r_[words, 0].astype(np.int64)
        n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        levels = max(1, int(text.max()).bit_length())
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=2**levels))].astype(np.int64)
        self.bwt = WaveletMatrix(last, levels)
        sampled = order % SAMPLE == 0
        self.marked = np.r_[0, np.cumsum(sampled)].astype(np.int64)
        self.samples = order[sampled]
        self.size = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval [lo, hi) of each row of ``phrases``, all rows at once, last word first."""
        lo, hi = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        alive = np.flatnonzero(hi > lo)
        for k in range(phrases.shape[1] - 2, -1, -1):
            word = phrases[alive, k]
            both = self.bwt.rank(np.r_[word, word], np.r_[lo[alive], hi[alive]]) + np.r_[self.first[word], self.first[word]]
            lo[alive], hi[alive] = both[: len(word)], both[len(word) :]
            alive = alive[hi[alive] > lo[alive]]
        none = np.ones(len(lo), bool)
        none[alive] = False
        hi[none] = lo[none]
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """The text position of the suffix at each place of the order."""
        found = np.full(len(places), -1, np.int64)
        todo, at, steps = np.arange(len(places)), places.astype(np.int64), 0
        while len(todo):
            hit = self.marked[at + 1] > self.marked[at]
            found[todo[hit]] = self.samples[self.marked[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            word, before = self.bwt.access(at)
            at = self.first[word] + before
            steps += 1
        return found
