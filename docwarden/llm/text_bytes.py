"""Vectorised words over the UTF-8 buffers of Arrow batches.

A word is a longest run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D), which is
the same as a run of characters matching ``[^\\x20\\x09-\\x0D]+``.  Words are named by 64-bit hashes, the
same in every process: a polynomial with random byte values modulo 2**64, mixed with the length.  Two given
words share a name with a chance of about 2**-60.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled in pieces, cut between words.
PIECE = 1 << 20
U64 = np.uint64


def worker_cache(key, make: Callable):
    """``make()`` once per Python process and key; tasks of one worker share the value."""
    store = sys.__dict__.setdefault("_docwarden_worker_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of SplitMix64)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xD1342543DE82EF95))


def _tables() -> dict:
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    plain = lower.copy()
    plain[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
    base, inverse = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
    return {
        "space": space,
        "lower": lower,
        "plain": plain,
        "value": seeded(256, 1),
        "power": _powers(base, PIECE + 65536),
        "inverse": _powers(inverse, PIECE + 65536),
        "base": base,
        "inverse_base": inverse,
    }


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """The words of some rows: names, byte ranges in ``data`` and, per row, the range of its words."""

    data: np.ndarray
    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # row i has words first[i] .. first[i + 1]


def row_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 row bounds; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(column: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """All words of a column of strings.

    ``lower`` maps A-Z to a-z before they are named; ``plain`` also takes all ASCII but letters and digits for blanks.
    """
    t = worker_cache("text_bytes", _tables)
    data, bounds = text_buffer(column)
    if plain:
        data = t["plain"][data]
    starts_row = np.zeros(len(data) + 1, dtype=bool)
    starts_row[bounds] = True
    names, starts, ends = [], [], []
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data):  # go on to a place between two words
            while to < len(data) and not (starts_row[to] or t["space"][data[to]]):
                step = data[to : to + 4096]
                stop = np.flatnonzero(t["space"][step] | starts_row[to : to + len(step)])
                to += int(stop[0]) if len(stop) else len(step)
        piece = data[at:to]
        if lower:
            piece = t["lower"][piece]
        word = ~t["space"][piece]
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before &= ~starts_row[at:to]
        s = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:] & ~starts_row[at + 1 : to]
        e = np.flatnonzero(word & ~after) + 1
        if len(s):
            power, inverse = t["power"], t["inverse"]
            if len(piece) > len(power):
                power, inverse = _powers(t["base"], len(piece)), _powers(t["inverse_base"], len(piece))
            with np.errstate(over="ignore"):
                run = np.zeros(len(piece) + 1, dtype=U64)
                np.cumsum(t["value"][piece] * power[: len(piece)], out=run[1:])
                names.append(mix64((run[e] - run[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    name = np.concatenate(names) if names else np.zeros(0, U64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return Words(data, name, start, end, np.searchsorted(start, bounds))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of two runs one after the other."""
    with np.errstate(over="ignore"):
        return mix64(left * U64(0xA24BAED4963EE407) + right)


def runs(name: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of ``length`` consecutive words, by the place of their first word."""
    n = len(name) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have, power, size = None, 0, name, 1  # power: names of all runs of size words
    while True:
        if length & size:
            out = power[:n] if out is None else _joined(out[:n], power[have : have + n])
            have += size
        if have == length:
            return mix64(out + U64(length))
        power = _joined(power[:-size], power[size:])
        size *= 2


def sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    rest = width - size
    return np.minimum(value[: len(value) - rest], value[rest:]) if rest else value


def distinct_shingles(name: np.ndarray, length: int = 5) -> np.ndarray:
    """Sorted distinct names of a text's shingles; a text with fewer words is one shingle, without words none."""
    if len(name) == 0:
        return np.zeros(0, U64)
    return np.unique(runs(name, min(length, len(name))))
