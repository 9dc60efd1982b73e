"""BM25 scores of runs of documents, in numpy: what a task does with the words it has.

Scores are summed as whole numbers of ``1 / UNIT``, so a sum does not depend on the order of rows and equal
documents tie exactly.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarden.functions import text as tx

# BM25 parameters.
K1 = 1.5
B = 0.75
UNIT = 1e10
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the narrowest type that holds them; its width comes first."""
    top = int(x.max(initial=0))
    kind = next(w for w in _WIDTHS if top <= np.iinfo(w).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def pack_runs(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """:func:`pack` of every run of ``x`` between two of ``starts``, all at once; no run is empty."""
    n = np.diff(starts)
    top = np.maximum.reduceat(x, starts[:-1])
    width = 1 + (top > 0xFF) + 2 * (top > 0xFFFF) + 4 * (top > 0xFFFFFFFF)
    offsets = np.concatenate([[0], np.cumsum(1 + n * width)])
    out = np.empty(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    for kind in _WIDTHS:
        w = np.dtype(kind).itemsize
        mine = np.flatnonzero(np.repeat(width == w, n))
        at = np.repeat(offsets[:-1] + 1 - starts[:-1] * w, n)[mine] + mine * w
        parts = x[mine].astype(kind).view(np.uint8).reshape(-1, w)
        for i in range(w):
            out[at + i] = parts[:, i]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpack_runs(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs of :func:`pack_runs`, one run after the other, and where each starts."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    width = data[offsets[:-1]].astype(np.int64)
    n = (np.diff(offsets) - 1) // width
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(starts[-1], np.int64)
    for kind in _WIDTHS:
        w = np.dtype(kind).itemsize
        mine = np.flatnonzero(np.repeat(width == w, n))
        at = np.repeat(offsets[:-1] + 1 - starts[:-1] * w, n)[mine] + mine * w
        out[mine] = np.stack([data[at + i] for i in range(w)], axis=1).reshape(-1).view(kind)
    return out, starts


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"u{b[0]}", offset=1).astype(np.int64)


def places_of(bitmap: bytes | None) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")) if bitmap else np.zeros(0, np.int64)


def let_go() -> None:
    """Give freed memory back to the machine; a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # what numpy has freed
        libc.malloc_trim(0)


# Documents whose words a task counts at once; Spark hands over up to 10 000 in a batch.
COUNT_DOCS = 512


def words_of(docs: DataFrame) -> DataFrame:
    return docs.select("id", tx.tokenise(F.col("content")).alias("tokens"))


def counted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, dl, words, counts`` of batches of :func:`words_of`, in pieces of bounded size."""
    for whole in batches:
        for at in range(0, whole.num_rows, COUNT_DOCS):
            batch = whole.slice(at, COUNT_DOCS)
            lists = batch.column(1)
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), n)
            size = max(len(coded.dictionary), 1)
            pair, count = np.unique(row * size + np.asarray(coded.indices).astype(np.int64), return_counts=True)
            bounds = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * size).astype(np.int32))
            words = coded.dictionary.take(pa.array(pair % size))
            lists = [pa.ListArray.from_arrays(bounds, words), pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), *lists], names=["id", "dl", "words", "counts"])


def packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, dl, n, words, counts`` of batches of :func:`counted_batches`: words as one text, counts packed, NULL without any.

    The JVM then moves and sorts three values a document instead of two for each of its words.
    """
    for batch in batches:
        ids, dl, words, counts = batch.columns
        n = np.asarray(pa.compute.list_value_length(words)).astype(np.int32)
        filled = n > 0
        packed = pack_runs(np.asarray(counts.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(n[filled], dtype=np.int64)])) if filled.any() else pa.array([], pa.binary())
        packed = packed.take(pa.array(np.cumsum(filled) - 1, mask=~filled))
        yield pa.RecordBatch.from_arrays([ids, dl, pa.array(n), pa.compute.binary_join(words, " "), packed], names=["id", "dl", "n", "words", "counts"])
    let_go()


def counted_words(docs: DataFrame) -> DataFrame:
    """``id, dl, n, words, counts``: the distinct words of every document and how often they occur, counted in place."""
    schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL("dl int, n int, words string, counts binary")])
    return words_of(docs).mapInArrow(lambda batches: packed_batches(counted_batches(batches)), schema)


def unpacked_words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Words and counts of a batch of :func:`counted_words`, one document after the other."""
    batch = batch.filter(pa.compute.greater(batch.column("n"), 0))
    if not batch.num_rows:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    # No word holds a space, and none is empty.
    return pa.compute.split_pattern(batch.column("words"), " ").flatten(), unpack_runs(batch.column("counts"))[0].astype(np.int32)


def units_of(idf: float, count: np.ndarray, length: np.ndarray, avg: float) -> np.ndarray:
    gain = count * (K1 + 1) / (count + K1 * (1 - B + B * length / avg))
    return np.floor(idf * gain * UNIT + 0.5).astype(np.int64)


def first_absent(taken: np.ndarray, n: int, k: int) -> np.ndarray:
    """The first ``k`` of the places 0 to ``n - 1`` that are not in the sorted ``taken``, in one merge."""
    # taken[j] - j places before taken[j] are free, so the z-th free one comes after all with fewer free before them.
    z = np.arange(k)
    free = z + np.searchsorted(taken - np.arange(len(taken)), z, side="right")
    return free[free < n]


class _Word:
    """The blocks of a word in one shard, in the order of their places; none overlap."""

    def __init__(self, blocks: list[dict]):
        self.blocks = sorted(blocks, key=lambda b: b["block"])
        self.n, self.first, self.last, self.most, self.least = (np.array([b[c] for b in self.blocks], dtype=np.int64) for c in ("n", "first", "last", "most", "least"))
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.decoded = 0
        self.idf: float | None = None

    def weigh(self, idf: float, avg: float) -> None:
        if idf != self.idf:
            self.idf, self.avg, self.kept, self.whole = idf, avg, {}, None
            # One unit more for rounding; a word with a negative weight may be missing, so it bounds nothing.
            self.bound = np.maximum(0, units_of(idf, self.most.astype(float), self.least.astype(float), avg) + 1) if idf > 0 else np.zeros(len(self.n), np.int64)

    def _block(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and units of one block, decoded once."""
        if j not in self.kept:
            b = self.blocks[j]
            if "open" not in b:
                self.decoded += b["n"]
            place, count, length = b["open"] if "open" in b else (b["first"] + np.cumsum(unpack(b["places"])), unpack(b["counts"]), unpack(b["lengths"]))
            self.kept[j] = place, units_of(self.idf, count.astype(float), length.astype(float), self.avg)
        return self.kept[j]

    def postings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and units of these blocks."""
        if self.whole is None and len(wanted) == len(self.blocks):
            parts = [self._block(j) for j in range(len(self.blocks))]
            self.whole, self.kept = tuple(np.concatenate(x) for x in zip(*parts)), {}
        if self.whole is None:
            parts = [self._block(j) for j in wanted.tolist()]
        elif len(wanted) == len(self.blocks):
            return self.whole
        else:
            parts = [tuple(x[self.starts[j] : self.starts[j + 1]] for x in self.whole) for j in wanted.tolist()]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _within(p: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places ``p`` lie in one of the sorted stretches from ``a`` to before ``z``, and in which."""
    at = np.searchsorted(a, p, side="right") - 1
    inside = np.flatnonzero((at >= 0) & (p < z[at]))
    return inside, at[inside]


class Shard:
    """The blocks of one shard that a search needs, decoded when they are first looked into."""

    def __init__(self, blocks: list[dict], gone: np.ndarray, docs: int, avg: float):
        self.gone, self.docs, self.avg = gone, docs, avg
        of: dict[str, list[dict]] = {}
        for b in blocks:
            of.setdefault(b["token"], []).append(b)
        self.words = {token: _Word(b) for token, b in of.items()}
        self.total = sum(b["n"] for b in blocks)

    @property
    def decoded(self) -> int:
        return sum(w.decoded for w in self.words.values())

    def _sums(self, mine: list[tuple[_Word, int]], a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores other than zero in these stretches, which are sorted and cross no border of a block."""
        offset = np.concatenate([[0], np.cumsum(z - a)])
        sums = np.zeros(offset[-1], dtype=np.int64)
        for word, qtf in mine:
            j = np.searchsorted(word.first, a, side="right") - 1
            j = j[(j >= 0) & (word.last[j] >= a)]
            if len(j):
                p, units = word.postings(j[np.flatnonzero(np.diff(j, prepend=-1))])
                inside, at = _within(p, a, z)
                sums[p[inside] - a[at] + offset[at]] += units[inside] * qtf
        inside, at = _within(self.gone, a, z)
        sums[self.gone[inside] - a[at] + offset[at]] = 0
        found = np.flatnonzero(sums)
        at = np.searchsorted(offset, found, side="right") - 1
        return a[at] + found - offset[at], sums[found]

    def scored(self, words: list[tuple[str, float, int]], k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores other than zero: of the best ``k`` documents above zero, or with None of all documents.

        Stretches are looked into best first, eight times as many at once as the time before, so that the work grows
        with the postings looked into and not with blocks times stretches.
        """
        place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine = []
        for token, idf, qtf in words:
            if token in self.words:
                self.words[token].weigh(idf, self.avg)
                mine.append((self.words[token], qtf))
        if not mine:
            return place, score
        if k is None:
            return self._all(mine)
        first, last = (np.concatenate([getattr(w, c) for w, _ in mine]) for c in ("first", "last"))
        most = np.concatenate([w.bound * qtf for w, qtf in mine])
        edges = np.unique(np.concatenate([first, last + 1]))
        bound = np.zeros(len(edges), dtype=np.int64)
        np.add.at(bound, np.searchsorted(edges, first), most)
        np.add.at(bound, np.searchsorted(edges, last + 1), -most)
        bound = np.cumsum(bound)[:-1]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done, step = 0, 1
        while done < len(order):
            now = order[done : done + step]
            if len(score) >= k:
                now = now[bound[now] >= score[k - 1]]
                if not len(now):
                    break
            done, step = done + step, step * 8
            now = np.sort(now)
            new_place, new_score = self._sums(mine, edges[now], edges[now + 1])
            above = new_score > 0
            place, score = np.concatenate([place, new_place[above]]), np.concatenate([score, new_score[above]])
            if len(score) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                place, score = place[near], score[near]
            best = np.lexsort((place, -score))[:k]
            place, score = place[best], score[best]
        return place, score

    def _all(self, mine: list[tuple[_Word, int]]) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(self.docs, dtype=np.int64)
        for word, qtf in mine:
            p, units = word.postings(np.arange(len(word.n)))
            sums[p] += units * qtf
        sums[self.gone] = 0
        place = np.flatnonzero(sums)
        return place, sums[place]

    def best(self, words: list[tuple[str, float, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`scored` of the best ``k``, filled up with the first documents that score zero, then with negative ones."""
        place, score = self.scored(words, None)
        order = np.lexsort((place, -score))
        above = order[score[order] > 0][:k]
        below = order[score[order] < 0][:k]
        zero = first_absent(np.unique(np.concatenate([place, self.gone])), self.docs, k)
        return np.concatenate([place[above], zero, place[below]]), np.concatenate([score[above], np.zeros(len(zero), np.int64), score[below]])

    def answers(self, queries: dict, k: int, whole: bool) -> tuple[list, np.ndarray, np.ndarray]:
        """Queries, places and scores of the best ``k`` of every query; ``whole`` with zeros and negative ones."""
        qids: list = []
        places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, words in queries.items():
            words = [w for w in words if w[0] is not None]
            place, score = self.best(words, k) if whole else self.scored(words, k)
            qids += [q] * len(place)
            places.append(place), scores.append(score)
        return qids, np.concatenate(places), np.concatenate(scores)


class Run:
    """A run of documents, of whose words only the wanted ones are held."""

    def __init__(self, wanted: pa.Array):
        self.wanted, self.docs = wanted, 0
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        ids, dl, words, counts = batch.columns
        code = pa.compute.index_in(words.flatten(), value_set=self.wanted)
        keep = np.flatnonzero(np.asarray(code.is_valid()))
        place = np.repeat(np.arange(self.docs, self.docs + len(ids)), np.asarray(pa.compute.list_value_length(words)))[keep]
        self.parts.append((np.array(dl), place.astype(np.int32), np.asarray(code.fill_null(0))[keep], np.asarray(counts.flatten())[keep]))
        self.ids.append(pa.concat_arrays([ids]))
        self.docs += len(ids)

    def shard(self, avg: float) -> tuple[pa.Array, Shard]:
        """The ids in their order, which gives each document its place, and the postings."""
        ids = pa.concat_arrays(self.ids)
        by_id = pa.compute.array_sort_indices(ids)
        rank = np.empty(self.docs, np.int64)
        rank[np.asarray(by_id)] = np.arange(self.docs)
        dl, place, code, counts = (np.concatenate(x) for x in zip(*self.parts))
        dl = dl[np.asarray(by_id)].astype(np.int64)
        place = rank[place]
        order = np.lexsort((place, code))
        place, code, counts = place[order], code[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.diff(code, prepend=-1))
        blocks = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(code)]):
            p, c = place[a:b], counts[a:b]
            length = dl[p]
            blocks.append({"token": self.wanted[int(code[a])].as_py(), "block": 0, "n": b - a, "first": int(p[0]), "last": int(p[-1]), "most": int(c.max()), "least": int(length.min()), "open": (p, c, length)})
        return ids.take(by_id), Shard(blocks, np.zeros(0, np.int64), self.docs, avg)
