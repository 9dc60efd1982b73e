"""Benchmark passages in documents: SimHash over windows of the items' lengths, a multi-index, exact comparison.

Every item has the SimHash of its words.  So has every window of a document that is as long as an item and shares a
shingle with one of that length (others have similarity 0 and are skipped).  The 64 bits of a hash are cut into
``RADIUS + 1`` blocks, each with an index of the items; two hashes that differ in at most ``RADIUS`` bits agree in a
block, so the index returns all items within the radius.  These are compared exactly: the weighted Jaccard
similarity of the multisets of five-word shingles, where a shingle weighs one over the number of items that have it.

Items are searched in blocks of bounded size.  With several blocks the items of each shingle are counted over all of
them, and each block and each document gets the counts above one of its own shingles, so blocks change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .passages import References, in_block, prepare, reference_blocks, reference_rows, seed_hits, window_starts
from .stored import Stored
from .text_bytes import U64, row_chunks, runs, words_of

RADIUS = 12
SIMILAR = 0.8
#: Counts of shingles that are sent to all tasks at once, about.
COUNTS = 2_000_000


def simhash(sums: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """Hashes from sums of bits, one row of 64 each; a bit is set if more than half of the words have it."""
    return np.packbits(2 * sums > np.reshape(words, (-1, 1)), axis=1, bitorder="little").view(U64).ravel()


def _bits(name: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(name).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class MultiIndex:
    """Hashes, searchable by Hamming distance up to ``radius`` without loss."""

    def __init__(self, hashes: np.ndarray, radius: int):
        self.hashes, self.radius = hashes, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:]):
            value = self._block(hashes, a, b)
            order = np.argsort(value, kind="stable")
            self.blocks.append((a, b, order, value[order]))

    @staticmethod
    def _block(hashes: np.ndarray, a: int, b: int) -> np.ndarray:
        return (hashes >> U64(a)) & U64((1 << int(b - a)) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, hash) pairs of places with a distance of at most the radius."""
        found = []
        for a, b, order, sorted_values in self.blocks:
            value = self._block(queries, a, b)
            first = np.searchsorted(sorted_values, value, side="left")
            n = np.searchsorted(sorted_values, value, side="right") - first
            query = np.repeat(np.arange(len(queries)), n)
            step = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
            other = order[first[query] + step]
            near = np.bitwise_count(queries[query] ^ self.hashes[other]) <= self.radius
            found.append(query[near] * len(self.hashes) + other[near])
        both = np.unique(np.concatenate(found))
        return both // max(len(self.hashes), 1), both % max(len(self.hashes), 1)


class Items:
    def __init__(self, refs: References, radius: int, common: tuple[np.ndarray, np.ndarray] | None = None):
        """``common``: sorted shingles of several items and their counts, where these are not all the items."""
        self.refs = refs
        self.length = np.array([len(w) for w in refs.words], dtype=np.int64)
        self.index = MultiIndex(np.concatenate([simhash(_bits(w).sum(axis=0, dtype=np.int64)[None], len(w)) for w in refs.words]), radius)
        every, items = common or np.unique(np.concatenate([np.unique(s) for s in refs.shingles]), return_counts=True)
        self.shingle, self.weight = every, 1 / items
        self.counts = [np.unique(s, return_counts=True) for s in refs.shingles]
        self.total = [float((self.weights(s) * n).sum()) for s, n in self.counts]

    def weights(self, shingles: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Of shingles, by ``known`` names and weights or the items' own; those of no item weigh one."""
        name, weight = known or (self.shingle, self.weight)
        if not len(name):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(name, shingles), len(name) - 1)
        return np.where(name[at] == shingles, weight[at], 1.0)

    def similarity(self, item: int, window: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        """Weighted Jaccard similarity of an item and a window's shingles."""
        mine, n = self.counts[item]
        theirs, m = np.unique(window, return_counts=True)
        both, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        shared = float((self.weights(both) * np.minimum(n[i], m[j])).sum())
        whole = self.total[item] + float((self.weights(theirs, known) * m).sum()) - shared
        return shared / whole if whole else 0.0


def _leaks_of(items: Items, name: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]], least: float, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[dict]:
    """The best window of each item that the words hold; hits: places and seeds by width of shingles."""
    best: dict[int, tuple[float, int, int]] = {}
    sums = None
    for width, (places, seed) in hits.items():
        _, first, lengths, _ = items.refs.seeds[width]
        n = first[seed + 1] - first[seed]
        place = np.repeat(places, n)
        length = lengths[np.repeat(first[seed], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
        shingles = runs(name, width)
        for size in np.unique(length):
            have = min(int(size), len(name))
            starts = window_starts(place[length == size], width, have, len(name))
            if sums is None:
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(name), axis=0, dtype=np.int32)])
            for at in range(0, len(starts), 4096):
                part = starts[at : at + 4096]
                hashes = simhash(sums[part + have] - sums[part], have)
                query, item = items.index.near(hashes)
                fits = items.length[item] == size
                for q, i in zip(query[fits].tolist(), item[fits].tolist()):
                    start = int(part[q])
                    s = items.similarity(i, shingles[start : start + have - width + 1], known)
                    if s >= least - 1e-12 and (i not in best or (-s, start) < (-best[i][0], best[i][1])):
                        best[i] = (s, start, have)
    return [{"item": items.refs.ids[i], "similarity": s, "start": start, "words": n} for i, (s, start, n) in sorted(best.items())]


def _counted(rows: DataFrame) -> DataFrame:
    """``shingle, width`` once for each item of ``rows(t)`` that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "t"):
            refs = prepare(list(range(batch.num_rows)), batch.column("t").to_pylist(), plain=False)
            each = [np.unique(s) for s in refs.shingles]
            found = np.concatenate([np.zeros(0, U64), *each])
            width = np.repeat(refs.width, np.array([len(e) for e in each], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(width.astype(np.int32))], names=["shingle", "width"])

    return rows.select("t").mapInArrow(run, "shingle long, width int")


def _sorted_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = counts.select("shingle", "n", "width").toArrow()
    name, n, width = (t.column(c).to_numpy() for c in t.column_names)
    name = name.astype(np.int64).view(U64)
    order = np.argsort(name)
    return name[order], n[order], width[order]


def _with_counts(docs: DataFrame, counts: Stored, text: str, fields: str) -> tuple[DataFrame, list[str]]:
    """Documents with columns of those of their shingles that several items have, and of these items' numbers."""
    parts, names = max(1, -(-counts.df.count() // COUNTS)), []
    for k in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(_sorted_counts(counts.df.where(F.pmod("shingle", F.lit(parts)) == k)))
        name = f"_counts{k}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            common, n, widths = shared.value
            for batch in row_chunks(batches, text):
                w = words_of(batch.column(text), lower=True)
                lists: list[list[int]] = []
                for a, b in zip(w.first[:-1], w.first[1:]):
                    own = [runs(w.name[a:b], int(width)) for width in np.unique(widths) if b - a >= width]
                    at = np.flatnonzero(np.isin(common, np.concatenate([np.zeros(0, U64), *own])))
                    lists.append(np.stack([common[at].view(np.int64), n[at]]).ravel().tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, name])

        fields += f", `{name}` array<long>"
        docs = docs.mapInArrow(run, fields)
        names.append(name)
    return docs, names


def _known(batch: pa.RecordBatch, names: list[str], row: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.array(batch.column(c)[row].as_py(), dtype=np.int64).reshape(2, -1) for c in names]
    name, n = np.concatenate(parts, axis=1)
    order = np.argsort(name.view(U64))
    return name.view(U64)[order], 1 / n[order]


def find_leaks(docs: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", text: str = "text", leaks: str = "leaks", radius: int = RADIUS, least: float = SIMILAR) -> DataFrame:
    """Add ``leaks``, one entry per item found: ``item, similarity, start, words`` of its most similar window.

    Words are compared with A-Z lower-cased.  Ties between windows go to the earliest.  A document shorter than an
    item is one window.  Null and empty texts, of documents or items, match nothing; equal items are each found;
    without items the list is empty.  Rows, also repeated ones, are kept one to one with all other columns; a
    column that has the new one's name is replaced.  Nothing is shuffled.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_key].dataType.simpleString()
    kind = f"array<struct<item:{item_type},similarity:double,start:int,words:int>>"
    out = docs.drop(leaks)
    columns = list(out.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    found = []
    rows, blocks = reference_rows(items, item_key, item_text)
    counts, known = None, []
    if blocks > 1:
        common = _counted(rows).groupBy("shingle").agg(F.count("*").alias("n"), F.max("width").alias("width")).where("n > 1")
        counts = Stored(common, "item-counts")
        out, known = _with_counts(out, counts, text, fields)
        fields += "".join(f", `{c}` array<long>" for c in known)
    for n, (ids, texts) in enumerate(reference_blocks(items, item_key, item_text)):
        shared = spark.sparkContext.broadcast((ids, texts))
        own = None
        if counts is not None:
            names = _counted(rows.where(in_block(n, blocks))).select("shingle").distinct()
            own = spark.sparkContext.broadcast(_sorted_counts(counts.df.join(names, "shingle", "left_semi"))[:2])
        name = f"_leaks{n}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, own=own) -> Iterator[pa.RecordBatch]:
            made = None
            for batch in row_chunks(batches, text):
                if made is None:
                    refs = prepare(*shared.value, plain=False)
                    made = (Items(refs, radius, own and own.value) if refs.ids else None,)
                lists = [[] for _ in range(batch.num_rows)]
                if made[0] is not None:
                    w = words_of(batch.column(text), lower=True)
                    by_row: dict[int, dict] = {}
                    row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
                    for width in made[0].refs.seeds:
                        place, seed = seed_hits(made[0].refs, w.name, width)
                        inside = row[place] == row[place + width - 1]
                        place, seed = place[inside], seed[inside]
                        for i in np.unique(row[place]):
                            own = row[place] == i
                            by_row.setdefault(int(i), {})[width] = (place[own] - w.first[i], seed[own])
                    for i, hits in by_row.items():
                        lists[i] = _leaks_of(made[0], w.name[w.first[i] : w.first[i + 1]], hits, least, _known(batch, known, i) if known else None)
                spec = pa.list_(pa.struct([("item", item_arrow), ("similarity", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, spec)], names=[*batch.schema.names, name])

        item_arrow = to_arrow_type(items.schema[item_key].dataType)
        out = out.mapInArrow(run, f"{fields}, `{name}` {kind}")
        fields += f", `{name}` {kind}"
        found.append(name)
    return out.select(*(F.col(f"`{c}`") for c in columns), F.concat(*found).alias(leaks))
