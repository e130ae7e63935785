"""Hierarchical index over bit codes in Gray order, for joins within a Hamming radius.

Codes are sorted by their rank in the reflected Gray sequence, so neighbours share long bit patterns.
Leaves hold one code each. An upper node covers ``FANOUT`` neighbours and factors out the bits they all
share, as a mask and a pattern. Differences between two nodes' shared patterns are a lower bound for every
pair below them, so whole groups are pruned once the accumulated differences exceed the radius; if even
the bits outside the shared pattern can't push a pair over the radius, the groups link as a whole.
"""

from __future__ import annotations

import numpy as np

FANOUT = 4
#: Node pairs expanded at a time; bounds memory whatever the number of codes.
CHUNK = 1 << 14
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class Forest:
    """Union-find over 0..n-1 for whole arrays of links; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            ra, rb = p[a], p[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


class GrayIndex:
    """Index over distinct codes that are already in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels = [(np.full(len(codes), _ONES), codes, np.arange(len(codes)))]
        while len(self.levels[-1][0]) > 1:
            mask, pattern, first = self.levels[-1]
            at = np.arange(0, len(mask), FANOUT)
            head = np.repeat(pattern[at], np.diff(np.append(at, len(mask))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ head), at)
            self.levels.append((shared, pattern[at] & shared, first[at]))

    def components(self, radius: int) -> np.ndarray:
        """For each code the position of the smallest code linked to it by steps of at most ``radius`` bits."""
        n, forest = len(self.codes), Forest(len(self.codes))
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > CHUNK:
                stack += [(level, i[k : k + CHUNK], j[k : k + CHUNK]) for k in range(0, len(i), CHUNK)]
                continue
            mask, pattern, first = self.levels[level]
            both = mask[i] & mask[j]
            apart = np.bitwise_count((pattern[i] ^ pattern[j]) & both)
            near = apart <= radius
            if level == 0:
                forest.link(i[near], j[near])
                continue
            i, j = i[near], j[near]
            whole = apart[near] + np.bitwise_count(~both[near]) <= radius
            if whole.any():  # every pair below links: tie each member to the first one
                end = np.append(first[1:], n)
                for a, b in zip(i[whole], j[whole]):
                    members = np.r_[first[a] : end[a], first[b] : end[b]]
                    forest.link(members, np.full(len(members), members[0]))
                i, j = i[~whole], j[~whole]
            if n > 1024 and len(i):  # groups that are already in one component need no visit
                r = forest.roots()
                low, high = np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)
                todo = (low[i] != high[j]) | (high[i] != low[j])
                i, j = i[todo], j[todo]
            if len(i):
                below = len(self.levels[level - 1][0])
                a, b = (np.repeat(i, FANOUT * FANOUT) * FANOUT + np.tile(np.repeat(np.arange(FANOUT), FANOUT), len(i))), (np.repeat(j, FANOUT * FANOUT) * FANOUT + np.tile(np.arange(FANOUT), FANOUT * len(j)))
                keep = (a < below) & (b < below) & ((a < b) | ((a == b) & (level > 1)))
                stack.append((level - 1, a[keep], b[keep]))
        return forest.roots()
