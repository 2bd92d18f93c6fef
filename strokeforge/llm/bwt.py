"""Burrows-Wheeler transforms of small collections of strings, and their merge.

A collection is rows of integer symbols; each row ends with a terminator (symbol 0) and is read
as a cycle. Rotations are sorted to the end, equal ones by row, so that the transform's
last-to-first mapping is consistent. merge() interleaves the transforms of several shards
(Holt and McMillan, 2014): the interleave by the first h symbols follows from the one by h - 1,
by dealing the rotations stably to the buckets of the symbols before them. Where two neighbours
first part at step h their common prefix is h - 1 symbols long (Egidi and Manzini, 2017), and
the blocks that are left after the last step are the intervals of rotations that repeat. No
suffix is sorted again.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """symbols: all rows after each other, each with its terminator; starts: where rows begin (and the end)."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        n = len(symbols)
        length = np.diff(starts)
        row = np.repeat(np.arange(len(length)), length)
        at, first, size = np.arange(n, dtype=np.int32), starts[:-1][row].astype(np.int32), length[row].astype(np.int32)
        rank = symbols.astype(np.int64)
        h = 1
        while n and h < length.max():
            key = rank * (int(rank.max()) + 1) + rank[first + (at - first + h) % size]
            rank = np.unique(key, return_inverse=True)[1]
            h *= 2
        self.order = np.lexsort((row, rank)).astype(np.int32) if n else at
        self.before = symbols[first + (at - first - 1) % size][self.order] if n else symbols

    def __len__(self) -> int:
        return len(self.order)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, blocks, common): whose rotation each place of the merged order holds, as each shard has
    them in order; the block of equal prefixes of depth symbols that it is in; and the length of its
    common prefix with the place before, depth at most."""
    who = np.concatenate([np.full(len(s), i, np.int16) for i, s in enumerate(shards)]) if shards else np.empty(0, np.int16)
    n = len(who)
    block, common = np.zeros(n, np.int32), np.full(n, depth, np.int32)
    before, steps = np.empty(n, np.int32), 0
    while steps < depth and n:
        for i, s in enumerate(shards):
            before[who == i] = s.before
        by = np.argsort(before.astype(np.uint16) if before.max() < 1 << 16 else before, kind="stable")
        who, c, b = who[by], before[by], block[by]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        common[new & (common == depth)] = steps
        block, steps = np.cumsum(new, dtype=np.int32) - 1, steps + 1
    return who, block, common
