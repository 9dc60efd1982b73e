"""A compressed index over sequences of numbers that answers backward search: how often, and where, a run occurs.

The index holds the Burrows-Wheeler transform of the sequence in a wavelet tree (one packed bit vector a level,
in matrix layout) with a count of ones per 64 bits, and the places of suffixes in sorted order.  Suffixes are
sorted by their first ``depth`` numbers, which is enough for runs of up to ``depth`` numbers.  All searches of a
batch go together, one number a step.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])[:-1].astype(np.int64)
        self.zeros = self.n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """``sequence``: numbers from 0 to ``size - 1``; its last one is a border that no run searched for holds."""

    def __init__(self, sequence: np.ndarray, size: int, depth: int):
        n = len(sequence)
        rank, reach, order = sequence.astype(np.int64), 1, np.argsort(sequence)
        while reach < depth and n > 1:  # suffixes by their first 2, 4, 8 ... numbers
            second = np.zeros(n, dtype=np.int64)
            second[:-reach] = rank[reach:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            reach *= 2
            if fresh[-1] == n - 1 or reach >= n:
                break
        self.n, self.order = n, order
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size))]).astype(np.int64)
        row = sequence[order - 1]  # the number before each suffix; that of the first is the last
        self.levels = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            bits = (row >> bit) & 1
            self.levels.append((bit, BitVector(bits.astype(np.uint8))))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        # Where the block of each number begins after the last level.
        self.block = np.zeros(size, dtype=np.int64)
        at = np.zeros(size, dtype=np.int64)
        number = np.arange(size)
        for bit, vector in self.levels:
            one = vector.ones(at)
            at = np.where((number >> bit) & 1, vector.zeros + one, at - one)
        self.block = at

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs in the transform before a place."""
        for bit, vector in self.levels:
            one = vector.ones(at)
            at = np.where((number >> bit) & 1, vector.zeros + one, at - one)
        return at - self.block[number]

    def extend(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the runs that get a number in front."""
        first = self.starts[number]
        return first + self.rank(number, low), first + self.rank(number, high)

    def repeated(self, sequence: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of runs of ``length`` numbers at ``starts`` in the indexed sequence, those that occur twice or more.

        Returns their positions in ``starts`` and the first suffix of each one's range, which names the run.  A
        search ends as soon as only the run itself is left.
        """
        active = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        for back in range(length - 1, -1, -1):
            low, high = self.extend(sequence[starts[active] + back], low, high)
            more = high - low > 1
            active, low, high = active[more], low[more], high[more]
        return active, low
