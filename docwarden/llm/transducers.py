"""Acyclic automata over sequences of names that give every prefix its count.

A path is a row of ``depth`` names; shorter ones are filled up with 0, which sorts first and names nothing.  Paths are
kept sorted, so the states are the distinct prefixes: a path adds those below the depth it shares with the path before
it, and the paths that pass a state are a range of rows.  A weight sits at the end of each path; the weight of a
state, the number of times its prefix was seen, is the sum over its range.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import zstandard

U64 = np.uint64


class Transducer(NamedTuple):
    """Sorted distinct paths, as places in the sorted ``names`` (0 is no name), with their weights."""

    names: np.ndarray
    path: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(path: np.ndarray, weight: np.ndarray | None = None) -> Transducer:
        """From names in any order; equal paths are added up."""
        names, place = np.unique(np.append(path.ravel(), U64(0)), return_inverse=True)
        return from_places(names, place[:-1].reshape(path.shape).astype(np.int32), weight)

    def shared(self) -> np.ndarray:
        """Names that each path has in common with the one before."""
        if not len(self.path):
            return np.zeros(0, np.int64)
        differ = np.ones((len(self.path), self.path.shape[1] + 1), dtype=bool)
        differ[1:, :-1] = self.path[1:] != self.path[:-1]
        differ[0, 1:] = False
        return differ.argmax(axis=1)

    def states(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows and weights of the states whose prefixes have ``depth`` names."""
        if not len(self.path):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.shared() < depth) if depth else np.zeros(1, np.int64)
        weight = np.add.reduceat(self.weight, first)
        whole = self.path[first, depth - 1] > 0 if depth else np.ones(1, dtype=bool)
        return first[whole], weight[whole]

    def pack(self) -> bytes:
        """Each path as the depth shared with the one before and the names that follow."""
        shared = self.shared()
        length = (self.path > 0).sum(axis=1)
        new = (np.arange(self.path.shape[1]) >= shared[:, None]) & (self.path > 0)
        used, label = np.unique(self.path[new], return_inverse=True)
        label = label.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
        small = self.weight.astype(np.uint8 if self.weight.max(initial=0) < 256 else np.int64)
        parts = [self.names[used].tobytes(), (shared * 16 + length).astype(np.uint8).tobytes(), label.tobytes(), small.tobytes()]
        head = np.array([len(self.path), self.path.shape[1], len(used), label.itemsize, small.itemsize], dtype=np.int64)
        return head.tobytes() + zstandard.compress(b"".join(parts), 1)

    @staticmethod
    def unpack(packed: bytes) -> Transducer:
        rows, depth, used, wide, weights = np.frombuffer(packed[:40], dtype=np.int64).tolist()
        data = zstandard.decompress(packed[40:])
        names = np.frombuffer(data, U64, used)
        ends = np.frombuffer(data, np.uint8, rows, used * 8)
        at, to = used * 8 + rows, len(data) - rows * weights
        label = np.frombuffer(data, np.uint16 if wide == 2 else np.uint32, (to - at) // wide, at)
        weight = np.frombuffer(data, np.uint8 if weights == 1 else np.int64, rows, to).astype(np.int64)
        shared, length = (ends >> 4).astype(np.int64), (ends & 15).astype(np.int64)
        column = np.arange(depth)
        path = np.zeros((rows, depth), dtype=np.int32)
        path[(column >= shared[:, None]) & (column < length[:, None])] = label.astype(np.int32) + 1
        # What a path shares was last written by the nearest path above that shares less.
        for d in range(depth):
            wrote = np.maximum.accumulate(np.where(shared <= d, np.arange(rows), -1))
            path[:, d] = np.where(shared > d, path[np.maximum(wrote, 0), d], path[:, d])
        return Transducer(np.concatenate([np.zeros(1, U64), names]), path, weight)


def from_places(names: np.ndarray, path: np.ndarray, weight: np.ndarray | None = None) -> Transducer:
    """From rows of places in the sorted ``names``, in any order; equal ones are added up."""
    bits = max(1, int(len(names)).bit_length())
    each = 63 // bits
    keys = []
    for a in range(0, path.shape[1], each):
        key = np.zeros(len(path), dtype=np.int64)
        for column in path[:, a : a + each].T:
            key = (key << bits) | column
        keys.append(key)
    order = np.lexsort(keys[::-1])
    path = path[order]
    first = np.ones(len(path), dtype=bool)
    if len(path):
        first[1:] = (path[1:] != path[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    ones = np.ones(len(path), np.int64) if weight is None else weight[order]
    return Transducer(names, path[at], np.add.reduceat(ones, at) if len(at) else np.zeros(0, np.int64))


def union(parts: list[Transducer]) -> Transducer:
    """All paths of the parts, with the sums of their weights."""
    names = np.unique(np.concatenate([p.names for p in parts]))
    paths = [np.searchsorted(names, p.names).astype(np.int32)[p.path] for p in parts]
    return from_places(names, np.concatenate(paths), np.concatenate([p.weight for p in parts]))


def compose(t: Transducer, depth_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all prefixes of every path, where each prefix is itself a path; and the greatest weight one name further.

    ``depth_of`` has the number of names of every path.  Column ``d`` of the first result is the weight of the prefix of
    ``d + 1`` names (0 beyond the path, and where the prefix is not a path).
    """
    rows, depth = t.path.shape
    out = np.zeros((rows, depth), dtype=np.int64)
    further = np.zeros(rows, dtype=np.int64)
    row = np.arange(rows)
    for d in range(1, depth + 1):
        # Prefixes sort right before what follows them, so the last path of d names is the one if it fits.
        last = np.maximum.accumulate(np.where(depth_of == d, row, -1))
        fits = (depth_of >= d) & (last >= 0)
        fits &= (t.path[np.maximum(last, 0), :d] == t.path[:, :d]).all(axis=1)
        out[fits, d - 1] = t.weight[last[fits]]
        child = fits & (depth_of == d + 1)
        np.maximum.at(further, last[child], t.weight[child])
    return out, further
