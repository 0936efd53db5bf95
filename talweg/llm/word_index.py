"""A compressed full-text index of words, in memory, and the matching statistics of texts streamed through it.

The index is the Burrows-Wheeler transform of a text of word numbers in a wavelet tree, with the counts of smaller
words. Backward search narrows an interval of the suffix order by one word to the left, by two ranks in the tree; an
interval of one place goes on by its last-to-first mapping, which is kept.
Order and common prefixes are known up to ``depth`` words, which is all that a search for windows of that size asks
for. Many texts are streamed at once, each from its end on: where a word cannot be put in front of what is matched,
the match loses words at its end, as few as lead to a larger interval, until the word fits or nothing is left.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32  # bits of a row
BELOW = (np.int64(1) << np.arange(BLOCK)) - 1


class WaveletTree:
    """A sequence of numbers by their bits from the highest down, each level stably sorted by those above.

    A level is its bits, ``BLOCK`` to a row, with the count of ones before each row in the row's upper half.
    """

    def __init__(self, values: np.ndarray, sigma: int):
        self.size, self.levels = len(values), max(1, int(sigma - 1).bit_length())
        self.rows, self.zeros = [], []
        rest = values
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % BLOCK + BLOCK, bool)]), bitorder="little").view(np.uint32)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            self.rows.append(np.concatenate([[0], ones[:-1]]) << 32 | packed)
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        #: Where a number's run begins in the order below the lowest level.
        self.runs = np.zeros(1 << self.levels, np.int64)
        begins = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])[: len(rest)])
        self.runs[rest[begins]] = begins

    def rank(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` numbers are the value."""
        for level in range(self.levels):
            row = self.rows[level][at >> 5]
            ones = (row >> 32) + np.bitwise_count(row & BELOW[at & 31])
            at = np.where(values >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at - self.runs[values]


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``codes`` ordered by their first ``depth`` codes, by prefix doubling over those still tied."""
    n = len(codes)
    known = max(1, 62 // max(1, int(codes.max(initial=0)).bit_length()))
    width = np.int64(int(codes.max(initial=0)).bit_length())
    padded = np.zeros(n + known, np.int64)
    padded[:n] = codes
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = key << width | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    opens = np.ones(n, bool)
    np.not_equal(key[order][1:], key[order][:-1], out=opens[1:])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    tied = ~opens
    tied[:-1] |= ~opens[1:]
    slots = np.flatnonzero(tied)
    while known < depth and len(slots):
        members = order[slots]
        pair = rank[members] * (n + 1) + rank[np.minimum(members + known, n)] + 1
        inner = np.argsort(pair, kind="stable")
        members, pair = members[inner], pair[inner]
        order[slots] = members
        first = np.ones(len(slots), bool)
        np.not_equal(pair[1:], pair[:-1], out=first[1:])
        rank[members] = np.maximum.accumulate(np.where(first, slots, 0))
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = slots[tied]
        known *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each slot the length, up to ``depth``, of what its suffix shares with the one before; 0 at both ends.

    Code 0 parts texts and equals nothing.
    """
    n = len(order)
    common = np.zeros(n + 1, np.int8)
    slots = np.arange(1, n)
    a, b = order[:-1].copy(), order[1:].copy()
    padded = np.append(codes, 0)
    for _ in range(depth):
        same = (padded[a] == padded[b]) & (padded[a] > 0)
        slots, a, b = slots[same], np.minimum(a[same] + 1, n), np.minimum(b[same] + 1, n)
        common[slots] += 1
        if not len(slots):
            break
    return common


class WordIndex:
    """The index of ``codes``, texts of word numbers from 1 to ``sigma`` - 1 that end in 0 each."""

    def __init__(self, codes: np.ndarray, sigma: int, depth: int):
        self.depth, self.size = depth, len(codes)
        self.order = suffix_order(codes, depth).astype(np.int32)
        self.common = common_prefixes(codes, self.order, depth)
        self.ahead = codes[self.order - 1]
        self.tree = WaveletTree(self.ahead, sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        #: For each slot the one of the suffix that begins a word earlier.
        slot = np.empty(len(codes), np.int64)
        slot[self.order] = np.arange(len(codes))
        self.last_to_first = slot[self.order - 1]
        # the nearest slots before and behind with a shorter common prefix: where an interval's parent ends
        n = self.size
        self.before, self.behind = np.zeros(n + 1, np.int64), np.full(n + 1, n)
        slots = np.arange(n + 1)
        for length in np.unique(self.common):
            own, less = self.common == length, self.common < length
            if length:
                self.before[own] = np.maximum.accumulate(np.where(less, slots, 0))[own]
                self.behind[own] = np.minimum.accumulate(np.where(less, slots, n)[::-1])[::-1][own]
        #: The suffixes that begin with the same ``depth`` words form a group.
        self.group = (np.cumsum(self.common[:-1] < depth) - 1).astype(np.int32)
        opens = np.flatnonzero(self.common[:-1] < depth)
        self.group_ends = np.append(opens, n).astype(np.int32)
        #: Where a group's words stand first in the text.
        self.first = np.minimum.reduceat(self.order, opens) if n else self.order

    def own_repeats(self) -> np.ndarray:
        """For each place of the text, whether its first ``depth`` words also start at an earlier one."""
        again = np.zeros(self.size, bool)
        deep = np.maximum(self.common[:-1], self.common[1:]) >= self.depth
        again[self.order[deep]] = self.order[deep] > self.first[self.group[deep]]
        return again

    def matches(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Matching statistics, up to ``depth``, of texts: at each place of ``flat`` how many words match the index.

        ``flat`` holds word numbers, -1 for words that the index does not know; text k ends before ``ends[k]``.
        """
        found = np.zeros(len(flat), np.int8)
        begins = np.concatenate([[0], ends[:-1]])
        at, stop = ends - 1, begins
        live = at >= stop
        at, stop = at[live], stop[live]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size)
        size = np.zeros(len(at), np.int64)
        while len(at):
            word = flat[at]
            known = word > 0
            word = word * known
            # the first word needs no rank, a range of places one for either end, the only place of a match none
            new_low, new_high = self.less[word], self.less[word + 1]
            fits = new_low < new_high
            matched = size > 0
            one = np.flatnonzero(matched & (high - low == 1))
            own = low[one]
            new_low[one] = self.last_to_first[own]
            new_high[one] = new_low[one] + 1
            fits[one] = self.ahead[own] == word[one]
            wide = np.flatnonzero(matched & (high - low != 1))
            if len(wide):
                base = new_low[wide]
                ranks = self.tree.rank(np.tile(word[wide], 2), np.concatenate([low[wide], high[wide]]))
                new_low[wide], new_high[wide] = base + ranks[: len(wide)], base + ranks[len(wide) :]
                fits[wide] = new_low[wide] < new_high[wide]
            fits &= known
            # a word that fits nowhere, or not even alone, ends the match
            none = ~fits & (size == 0) | ~known
            size = np.where(fits, size + 1, np.where(none, 0, size))
            full = fits & (size > self.depth)
            group = self.group[np.minimum(new_low, self.size - 1)]
            low_, high_ = np.where(fits, new_low, np.where(none, 0, low)), np.where(fits, new_high, np.where(none, self.size, high))
            low_, high_ = np.where(full, self.group_ends[group], low_), np.where(full, self.group_ends[group + 1], high_)
            size = np.minimum(size, self.depth)
            found[at[fits]] = size[fits]
            shrink = ~fits & ~none
            if shrink.any():
                a, b = low[shrink], high[shrink]
                left, right = self.common[a], self.common[b]
                edge = np.where(left >= right, a, b)
                length = np.maximum(left, right)
                low_[shrink] = np.where(length > 0, self.before[edge], 0)
                high_[shrink] = np.where(length > 0, self.behind[edge], self.size)
                size[shrink] = length
            at = at - (fits | none)
            live = at >= stop
            at, stop, low, high, size = at[live], stop[live], low_[live], high_[live], size[live]
        return found
