"""Scores of texts under a Katz back-off bigram model learned from a part of them.

P(w | v) = d(c(vw)) c(vw) / c(v) for pairs seen in training, else a(v) P(w); P(w) is a discounted unigram, and all
words not seen in training share its freed mass.  d is the Good-Turing discount of counts up to five, from
smoothed counts of counts; a(v) makes
the probabilities of all words after v add up to one exactly: the mass freed after v over the unigram mass of
words never seen after v.

Texts are tokenised once into cells, blocks of documents of bounded size.  Counts live in tables partitioned by
ranges of keys ("buckets"); a key is the 64-bit name of a word or of a pair of words.  A cell sends each bucket the
sorted keys it holds with its training counts, and gets back the corpus counts of just these keys, so one
exchange both counts and answers.  One cell of those that hold a pair is told to own it and adds it to
its context's sums, which go through a second exchange of the same kind.  Every key is pre-aggregated in its cell,
so a word or pair that makes up a third of all tokens costs one entry per cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import Stored, partitions, release
from .text_bytes import U64, mix64, row_chunks, words_of

#: Bytes of text of a cell, about, and keys of a bucket, about.
CELL = 4 << 20
BUCKET_KEYS = 1 << 20
#: Counts above this are not discounted.
DISCOUNTED = 5
_END, _START = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_WORD, _PAIR = 0, 1


def pack(x: np.ndarray) -> bytes:
    """A column of 64-bit numbers, compressed byte by byte of the number."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


def _slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in the sorted ``keys``."""
    borders = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])


class Cell(NamedTuple):
    names: np.ndarray  # sorted names of the cell's words, with the end and the start of texts
    word: np.ndarray  # per token: its place in names
    train: np.ndarray  # per token
    doc: np.ndarray  # per token
    docs: int
    pairs: np.ndarray  # sorted keys of all pairs
    pair: np.ndarray  # per token: the place in pairs of (word before, word)
    left: np.ndarray  # per pair: place in names
    right: np.ndarray


def _open(row: dict) -> Cell:
    names = _unpack_sorted(row["names"])
    word = np.frombuffer(zstandard.decompress(row["tokens"]), dtype=np.int32)
    lengths = np.frombuffer(row["lengths"], dtype=np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    train = np.repeat(np.frombuffer(row["train"], dtype=bool), lengths)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(names, _START)
    with np.errstate(over="ignore"):
        key = mix64(mix64(names[before] + U64(1)) + names[word])
    pairs, pair = np.unique(key, return_inverse=True)
    some = np.empty(len(pairs), dtype=np.int64)
    some[pair] = np.arange(len(pair))
    return Cell(names, word, train, doc, len(lengths), pairs, pair, before[some], word[some])


def _cells(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held, size_held = [], 0

        def close() -> pa.RecordBatch:
            nonlocal made
            made += 1
            lengths = np.concatenate([h[1] for h in held]) + 1
            all_words = np.full(int(lengths.sum()), _END, dtype=U64)
            inner = np.ones(len(all_words), dtype=bool)
            inner[np.cumsum(lengths) - 1] = False
            all_words[inner] = np.concatenate([h[0] for h in held])
            names = np.unique(np.append(all_words, _START))
            tokens = np.searchsorted(names, all_words).astype(np.int32) if len(names) < 1000 else np.unique(all_words, return_inverse=True)[1]
            if len(names) >= 1000:  # places among all names, the start included
                tokens = (tokens + (tokens >= np.searchsorted(names, _START))).astype(np.int32)
            keys = [k for h in held for k in h[2]]
            train = np.array([t for h in held for t in h[3]], dtype=bool)
            row = [(part << 31) + made, keys, train.tobytes(), lengths.astype(np.int64).tobytes(), zstandard.compress(tokens.tobytes(), 1), _pack_sorted(names)]
            types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["cell", "keys", "train", "lengths", "tokens", "names"])

        for batch in row_chunks(batches, "_text"):
            w = words_of(batch.column("_text"), lower=True)
            held.append((w.name, np.diff(w.first), batch.column("_key").to_pylist(), batch.column("_train").to_pylist()))
            size_held += len(w.data) + 64 * batch.num_rows
            if size_held >= size:
                yield close()
                held, size_held = [], 0
        if held:
            yield close()

    return docs.mapInArrow(run, "cell long, keys array<long>, train binary, lengths binary, tokens binary, names binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _requests(cells: DataFrame, buckets: int) -> DataFrame:
    """Keys of each cell with their training counts, by kind and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _open(row)
            for kind, keys, counts in (
                (_WORD, c.names, np.bincount(c.word[c.train], minlength=len(c.names))),
                (_PAIR, c.pairs, np.bincount(c.pair[c.train], minlength=len(c.pairs))),
            ):
                at = _slices(keys, buckets)
                out = [(kind, b, row["cell"], _pack_sorted(keys[at[b] : at[b + 1]]), pack(counts[at[b] : at[b + 1]])) for b in range(buckets) if at[b] < at[b + 1]]
                yield _batch(out, ["kind", "bucket", "cell", "sent", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return cells.mapInArrow(run, "kind int, bucket int, cell long, sent binary, counts binary")


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in _rows(batches):
        if held and any(held[-1][k] != row[k] for k in by):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _answers(requests: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts of each cell's keys, which of them the cell owns, and each bucket's counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ("kind", "bucket")):
            sent = [_unpack_sorted(r["sent"]) for r in group]
            keys, first, where = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            at = np.cumsum([0, *map(len, sent)])
            for i, r in enumerate(group):  # keys of one cell are distinct
                total[where[at[i] : at[i + 1]]] += unpack(r["counts"])
            own = np.zeros(len(where), dtype=bool)
            own[first] = total > 0
            spectrum = [int((total == k).sum()) for k in range(1, DISCOUNTED + 2)] + [int((total > 0).sum()), int(total.sum())]
            out = []
            for i, r in enumerate(group):
                part = slice(at[i], at[i + 1])
                out.append((r["kind"], r["bucket"], r["cell"], pack(total[where[part]]), np.packbits(own[part]).tobytes(), spectrum if i == 0 else None))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield _batch(out, ["kind", "bucket", "cell", "totals", "owned", "spectrum"], types)

    dealt = requests.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket", "cell")
    return dealt.mapInArrow(run, "kind int, bucket int, cell long, totals binary, owned binary, spectrum array<long>")


def discounts(spectrum: list[int]) -> np.ndarray:
    """Factors of the counts 0 to ``DISCOUNTED`` from the numbers of keys with the counts 1, 2, 3 ...

    Good-Turing estimates, scaled so that in all they free the mass of the keys seen once.  The numbers are first
    smoothed as in Simple Good-Turing, by the line through their logarithms; with n_r = C r^b the estimates are
    r* / r = ((r + 1) / r)^(b + 1), and all factors lie between 0 and 1 for every slope b.  Only without a line (no
    key seen once, or fewer than two different counts) the factors of absolute discounting stand in: (r - D) / r,
    D = n1 / (n1 + 2 n2), at most 0.9.
    """
    n = np.array(spectrum[: DISCOUNTED + 1], dtype=np.float64)
    count = np.arange(1, DISCOUNTED + 1)
    out = np.ones(DISCOUNTED + 1)
    seen = np.flatnonzero(n) + 1
    if len(seen) > 1 and n[0]:
        # A count without keys spreads over the gap: each n_r over half the distance of its neighbours.
        below, above = np.append(0, seen[:-1]), np.append(seen[1:], 2 * seen[-1] - seen[-2])
        slope = np.polyfit(np.log(seen), np.log(2 * n[seen - 1] / (above - below)), 1)[0]
        # x^(b + 1) - 1 over b + 1, which for b = -1 is log x.
        power = lambda x: np.log(x) if abs(slope + 1) < 1e-9 else np.expm1((slope + 1) * np.log(x))
        out[1:] = 1 - power((count + 1) / count) / power(DISCOUNTED + 1)
    else:
        d = min(n[0] / (n[0] + 2 * n[1]), 0.9) if n[0] else 0.0
        out[1:] = (count - d) / count
    return out


class Model(NamedTuple):
    """What all tasks need of the whole corpus: a dozen numbers."""

    tokens: int
    types: int
    train_docs: int
    word_factor: np.ndarray
    pair_factor: np.ndarray
    unknown: float  # mass of all unseen words
    scale: float  # of seen words' discounted shares


def _factor(factors: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count <= DISCOUNTED, factors[np.minimum(count, DISCOUNTED)], 1.0)


def _model(answers: DataFrame, train_docs: int) -> Model:
    summed = [F.sum(F.col("spectrum")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 3)]
    found = {r["kind"]: [r[f"s{i}"] or 0 for i in range(DISCOUNTED + 3)] for r in answers.where("spectrum IS NOT NULL").groupBy("kind").agg(*summed).collect()}
    words, pairs = (found.get(k, [0] * (DISCOUNTED + 3)) for k in (_WORD, _PAIR))
    factor, n = discounts(words), words[-1]
    freed = sum((1 - factor[r]) * r * words[r - 1] for r in range(1, DISCOUNTED + 1)) / n if n else 1.0
    scale = 1.0
    if freed <= 0:  # nothing to discount: one more token, an unseen one
        freed, scale = 1 / (n + 1), n / (n + 1)
    return Model(n, words[-2], train_docs, factor, discounts(pairs), freed, scale)


def _word_shares(m: Model, count: np.ndarray) -> np.ndarray:
    """P(w) of words by their training counts; the unseen ones together are one word."""
    return np.where(count > 0, m.scale * _factor(m.word_factor, count) * count / max(m.tokens, 1), m.unknown)


def _context_counts(m: Model, c: Cell, count: np.ndarray) -> np.ndarray:
    out = count.copy()
    out[np.searchsorted(c.names, _START)] = m.train_docs
    return out


def _counts(row: dict, c: Cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of the cell's words and pairs, and the pairs it owns."""
    parts: dict[int, list] = {_WORD: [], _PAIR: []}
    for a in sorted(row["answers"], key=lambda a: a["bucket"]):
        total = unpack(a["totals"])
        parts[a["kind"]].append((total, np.unpackbits(np.frombuffer(a["owned"], np.uint8), count=len(total)).astype(bool)))
    word, pair = (np.concatenate([p[0] for p in parts[k]]) for k in (_WORD, _PAIR))
    return word, pair, np.concatenate([p[1] for p in parts[_PAIR]])


def _context_sums(joined: DataFrame, shared, buckets: int) -> DataFrame:
    """Per cell: for each context, the mass and the unigram mass of the pairs that the cell owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for row in _rows(batches):
            c = _open(row)
            word, pair, own = _counts(row, c)
            context = _context_counts(m, c, word)
            left, right, n = c.left[own], c.right[own], pair[own]
            mass = np.bincount(left, _factor(m.pair_factor, n) * n / np.maximum(context[left], 1), len(c.names))
            below = np.bincount(left, _word_shares(m, word)[right], len(c.names))
            seen = context > 0
            keys, mass, below = c.names[seen], mass[seen], below[seen]
            at = _slices(keys, buckets)
            out = [(b, row["cell"], *(f(v[at[b] : at[b + 1]]) for f, v in ((_pack_sorted, keys), (pack, mass), (pack, below)))) for b in range(buckets) if at[b] < at[b + 1]]
            if out:
                yield _batch(out, ["bucket", "cell", "sent", "mass", "below"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    return joined.mapInArrow(run, "bucket int, cell long, sent binary, mass binary, below binary")


def _summed_contexts(sums: DataFrame, buckets: int) -> DataFrame:
    """Per cell: one number for each of its contexts, the mass freed over the unigram mass of words not seen after it.

    A context whose pairs free nothing gets minus one over that unigram mass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ("bucket",)):
            sent = [_unpack_sorted(r["sent"]) for r in group]
            keys, where = np.unique(np.concatenate(sent), return_inverse=True)
            mass, below = (np.bincount(where, np.concatenate([unpack(r[c], np.float64) for r in group]), len(keys)) for c in ("mass", "below"))
            back = np.where(mass > 1 - 1e-9, -1.0, 1 - mass) / np.maximum(1 - below, 1e-300)
            at = np.cumsum([0, *map(len, sent)])
            out = [(r["bucket"], r["cell"], pack(back[where[at[i] : at[i + 1]]])) for i, r in enumerate(group)]
            yield _batch(out, ["bucket", "cell", "back"], [pa.int32(), pa.int64(), pa.binary()])

    dealt = sums.repartition(buckets, "bucket").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "bucket int, cell long, back binary")


def _scores(joined: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for row in _rows(batches):
            c = _open(row)
            word, pair, _ = _counts(row, c)
            context = _context_counts(m, c, word)
            share = _word_shares(m, word)
            seen = context > 0
            back = np.ones(len(c.names))
            contexts = sorted(row["contexts"] or [], key=lambda a: a["bucket"])
            if contexts:
                back[seen] = np.concatenate([unpack(a["back"], np.float64) for a in contexts])
            # After a context whose pairs free nothing, one more token is assumed, an unseen one.
            full = back < 0
            shrink = np.where(full, context / (context + 1), 1.0)
            back = np.where(full, -back / (context + 1), back)
            p = np.where(pair > 0, shrink[c.left] * _factor(m.pair_factor, pair) * pair / np.maximum(context[c.left], 1), back[c.left] * share[c.right])
            score = np.bincount(c.doc, np.log10(p)[c.pair], c.docs)
            base = np.bincount(c.doc, np.log10((word + 0.1) / (m.tokens + 0.1 * (m.types + 1)))[c.word], c.docs)
            known = np.bincount(c.doc, (word > 0)[c.word], c.docs).astype(np.int64)
            train = np.frombuffer(row["train"], dtype=bool)
            arrays = [pa.array(row["keys"], pa.int64()), pa.array(train), pa.array(np.frombuffer(row["lengths"], np.int64)), pa.array(known), pa.array(np.full(c.docs, m.tokens)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, "key long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", cell_bytes: int = CELL, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: ``key, train, n_tokens, n_known, train_tokens, base_score, score``.

    The model is learned from the rows where ``train`` holds (null counts as false) and applied to all.  Tokens
    are the words, A-Z lower-cased, and one end of text.  ``score`` is the text's log10 probability;
    ``base_score`` that under an add-0.1 unigram; ``n_known`` counts tokens seen in training.  Null texts count as
    empty ones, which have the one token of the end; null keys and repeated rows stay as they are.  Other columns
    are left out.  Without training rows every token has probability one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cells = Stored(_cells(rows, cell_bytes), "text-cells")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths, train = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["train"], bool)
            yield _batch([(int(lengths.sum()), int(train.sum()))], ["tokens", "trained"], [pa.int64(), pa.int64()])

    size = cells.df.select("lengths", "train").mapInArrow(counted, "tokens long, trained long").agg(F.sum("tokens").alias("n"), F.sum("trained").alias("d")).first()
    buckets = max(partitions(spark), -(-(size["n"] or 0) // bucket_keys))

    answers = Stored(_answers(_requests(cells.df, buckets), buckets), "count-answers")
    shared = spark.sparkContext.broadcast(tuple(_model(answers.df, size["d"] or 0)))
    release(spark)
    by_cell = answers.df.groupBy("cell").agg(F.collect_list(F.struct("kind", "bucket", "totals", "owned")).alias("answers"))
    sums = _context_sums(cells.df.join(by_cell, "cell"), shared, buckets)
    contexts = Stored(_summed_contexts(sums, buckets), "context-answers")
    del sums
    release(spark)
    by_context = contexts.df.groupBy("cell").agg(F.collect_list(F.struct("bucket", "back")).alias("contexts"))
    return _scores(cells.df.join(by_cell, "cell").join(by_context, "cell", "left"), shared)
