"""Reference texts (benchmark items, licence templates) prepared for searches in windows of documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_bytes import U64, runs, words_of

SHINGLE = 5
#: Reference texts that are sent to all tasks at once, and their bytes; more are searched block by block.
BLOCK_TEXTS, BLOCK_BYTES = 50_000, 64 << 20


class References(NamedTuple):
    ids: list
    words: list[np.ndarray]  # names of words
    shingles: list[np.ndarray]  # names of all shingles, in order, of min(5, words) words
    width: np.ndarray  # words of a shingle
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by width: sorted names, offsets, lengths; filter


def reference_rows(table: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows ``k, t`` of the reference table that have a text, and the number of their blocks."""
    rows = table.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    return rows, max(1, -(-size["n"] // BLOCK_TEXTS), -(-(size["b"] or 0) // BLOCK_BYTES))


def in_block(i: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i


def reference_blocks(table: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the reference table in blocks of bounded size, together all of its rows with a text.

    The table is a stated set of queries; all documents meet every block.
    """
    rows, blocks = reference_rows(table, key, text)
    for i in range(blocks):
        found = rows.where(in_block(i, blocks)).orderBy("k", "t").collect()
        yield [r["k"] for r in found], [r["t"] for r in found]


def prepare(ids: list, texts: list[str], plain: bool) -> References:
    w = words_of(pa.array(texts, pa.string()), lower=True, plain=plain)
    names = [w.name[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    kept = [i for i, n in enumerate(names) if len(n)]
    words = [names[i] for i in kept]
    width = np.array([min(SHINGLE, len(n)) for n in words], dtype=np.int64)
    shingles = [runs(n, int(k)) for n, k in zip(words, width)]
    seeds = {}
    for k in sorted(set(width.tolist())):
        pairs = sorted({(int(s), len(words[i])) for i in range(len(words)) if width[i] == k for s in shingles[i]})
        name = np.array([p[0] for p in pairs], dtype=U64)
        length = np.array([p[1] for p in pairs], dtype=np.int64)
        own, first = np.unique(name, return_index=True)
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(own >> U64(44)).astype(np.int64)] = True
        seeds[k] = (own, np.append(first, len(name)), length, sieve)
    return References([ids[i] for i in kept], words, shingles, width, seeds)


def seed_hits(refs: References, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles in ``name`` that some reference has, and their index among the seeds of this width."""
    own, _, _, sieve = refs.seeds[width]
    all_runs = runs(name, width)
    some = np.flatnonzero(sieve[(all_runs >> U64(44)).astype(np.int64)]) if len(all_runs) else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, all_runs[some]), len(own) - 1)
    hit = own[at] == all_runs[some]
    return some[hit], at[hit]


def window_starts(places: np.ndarray, width: int, length: int, words: int) -> np.ndarray:
    """Starts of all windows of ``length`` words, in a text of so many words, that hold a shingle at a place."""
    last = words - length
    low, high = np.maximum(places - (length - width), 0), np.minimum(places, last)
    edge = np.zeros(last + 2, dtype=np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)
