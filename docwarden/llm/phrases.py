"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

1. Words are counted per language, then pairs, then longer phrases.  What is frequent at one step is sent to all tasks
   of the next as a bit filter of fixed size: a phrase with a rare word or pair is too rare itself, so
   these end a piece.  The filters have no false negatives; beyond their capacity they only save less.
2. Every shard (a block of text) turns its windows, the next two or five words from every word on, into a count
   transducer (:mod:`transducers`), cuts it at the borders of prefix ranges, and sends each range its slice.
3. A range unites the slices of all shards and sums weights by prefix.  Prefixes that reach over a border are
   added up afterwards; the others are complete.  A range is some of the sorted distinct windows, so a very common word
   or pair is spread over many ranges, and a common window is one path per shard.
4. The frequent phrases are dealt to ranges once more, forwards and backwards, and composed with themselves: that gives
   every phrase the counts of all its first parts and of all its last parts, and of the phrases one word longer.
5. Scores are whole numbers in decimals; the best of each language are ranked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Stored, release
from .text_bytes import U64, mix64, row_chunks, text_buffer, words_of, worker_cache
from .transducers import Transducer, compose, from_places, union

LONGEST, FREQUENT, BEST = 5, 100, 2000
#: Words of a shard, words of a range, and frequent phrases of a range.
SHARD, RANGE, RANGE_PHRASES = 1 << 18, 1 << 20, 1 << 18
#: Bits of the filters of frequent words and of frequent pairs.
FILTER_BITS = 1 << 25
#: Documents per range whose windows the borders are taken from, and borders' windows per range.
SAMPLE_DOCS, SAMPLE_KEYS = 20, 32
#: Languages up to this number have their totals sent to all tasks.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"
_DIGITS = (16, 14, 12, 12, 10)


def _bytes_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 10
    return table


def lang_name(lang: str) -> int:
    """The 64-bit name of a language; never 0."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") or 1


class Stream:
    """The words of some texts one after the other: names, languages, whether a piece ends after them."""

    def __init__(self, text: pa.Array, langs: list[str]):
        data, bounds = text_buffer(text)
        data = worker_cache("phrase_bytes", _bytes_table)[data]
        plain = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        self.words = w = words_of(plain)
        self.name = np.maximum(w.name, U64(1))
        row = np.repeat(np.arange(len(text)), np.diff(w.first))
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], dtype=np.int32)[row] if len(langs) else np.zeros(0, np.int32)
        self.ends = np.ones(len(row), dtype=bool)
        if len(row) > 1:
            between = np.column_stack([w.end[:-1], w.start[1:]]).ravel()
            # A gap of no bytes is one between two texts; reduceat gives the byte itself there, and rows differ.
            self.ends[:-1] = np.logical_or.reduceat(np.append(data == 10, False), between)[::2] | (row[1:] != row[:-1])

    def lang_names(self) -> np.ndarray:
        return np.array([lang_name(x) for x in self.langs], dtype=U64)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[Stream]:
    """The texts of a task, some million words at a time (a longer text is whole)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in row_chunks(batches, "t"):
        held.append(batch)
        size += batch.column("t").nbytes
        if size >= SHARD * 6:
            yield _stream(held)
            held, size = [], 0
    if held:
        yield _stream(held)


def _stream(held: list[pa.RecordBatch]) -> Stream:
    whole = pa.Table.from_batches(held).combine_chunks()
    column = whole.column("t").cast(pa.large_string()).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return Stream(column, whole.column("lang").to_pylist())


def range_key(path: np.ndarray, fill: int = 0, names: np.ndarray | None = None) -> np.ndarray:
    """A number by which windows (language and up to five names) are dealt; equal prefixes give equal leading bits.

    Missing names count as the least digits, or with ``fill`` as the greatest.  With ``names`` paths hold places in it.
    """
    out = np.zeros(len(path), dtype=U64)

    def column(i: int) -> np.ndarray:
        if i >= path.shape[1]:
            return np.zeros(len(path), U64)
        return path[:, i] if names is None else names[path[:, i]]

    with np.errstate(over="ignore"):
        for i, bits in enumerate(_DIGITS):
            name = column(i + 1)
            mixed = mix64(name + (column(0) * U64(0xA24BAED4963EE407) if i == 0 else U64(i))) >> U64(64 - bits)
            mixed[name == 0] = U64((1 << bits) - 1 if fill else 0)
            out = (out << U64(bits)) | mixed
    return out


def _bit(lang: np.ndarray, *names: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = lang
        for name in names:
            out = mix64(name + out * U64(0xD1342543DE82EF95))
        return (out % U64(FILTER_BITS)).astype(np.int64)


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def windows(s: Stream, words: np.ndarray, pairs: np.ndarray | None = None, longest: int = LONGEST, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Language and the next words up to the end of the piece, where these are ``least`` at least, a shard at a time.

    Words and pairs that are not in the filters end a piece.  Gives the sorted names of the shard, 0 first, and rows
    of places in them.
    """
    if not len(s.name):
        return
    langs = s.lang_names()
    lang = langs[s.lang]
    good = _is_set(words, _bit(lang, s.name))
    ends = s.ends.copy()
    ends[:-1] |= ~good[1:]
    if pairs is not None:
        ends[:-1] |= ~_is_set(pairs, _bit(lang[:-1], s.name[:-1], s.name[1:]))
    del lang
    stop = np.flatnonzero(ends)
    start = np.flatnonzero(good)
    left = np.minimum(stop[np.searchsorted(stop, start)] - start + 1, longest)
    start, left = start[left >= least], left[left >= least]
    for at in range(0, len(start), SHARD):
        i, n = start[at : at + SHARD], left[at : at + SHARD]
        a, b = int(i[0]), int(i[-1] + n[-1])
        names, place = np.unique(np.concatenate([np.zeros(1, U64), langs, s.name[a:b]]), return_inverse=True)
        place = place.astype(np.int32)
        word, lang = place[1 + len(langs) :], place[1 : 1 + len(langs)]
        path = np.zeros((len(i), longest + 1), dtype=np.int32)
        path[:, 0] = lang[s.lang[i]]
        for d in range(longest):
            has = n > d
            path[has, d + 1] = word[i[has] + (d - a)]
        yield names, path


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, l, word, name, n``: occurrences of all words; the row with a null word has those of all together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _streams(batches):
            names = s.lang_names()
            order = np.lexsort((s.name, s.lang))
            lang, name = s.lang[order], s.name[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (lang[1:] != lang[:-1]) | (name[1:] != name[:-1])
            at = np.flatnonzero(new)
            first = order[at]
            data = s.words.data.tobytes()
            text = [data[a:b].decode("utf-8", "replace") for a, b in zip(s.words.start[first].tolist(), s.words.end[first].tolist())]
            total = np.bincount(s.lang, minlength=len(names))
            some = np.flatnonzero(total)
            l = np.concatenate([lang[at], some])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s.langs[i] for i in l.tolist()], pa.string()),
                    pa.array(names[l].view(np.int64)),
                    pa.array([*text, *[None] * len(some)], pa.string()),
                    pa.array(np.concatenate([name[at], np.zeros(len(some), U64)]).view(np.int64)),
                    pa.array(np.concatenate([np.diff(np.append(at, len(order))), total[some]])),
                ],
                names=["lang", "l", "word", "name", "n"],
            )

    counted = docs.mapInArrow(run, "lang string, l long, word string, name long, n long")
    return counted.groupBy("lang", "l", "word", "name").agg(F.sum("n").alias("n"))


def _filter(grams: DataFrame, length: int) -> np.ndarray:
    """Bits of the frequent phrases ``l, gram`` of one length; at most ``FILTER_BITS`` of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, _ = _paths(b.column("l"), b.column("gram"), length, False)
            bit = _bit(*path.T)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.int64(1) << (bit & 31))], names=["place", "bits"])

    rows = grams.select("l", "gram").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[np.asarray(rows.column("place"))] = np.asarray(rows.column("bits")).astype(np.uint32)
    return out.view(np.uint8)


class Step(NamedTuple):
    """What a pass over the texts looks for: windows of ``least`` to ``longest`` words that the filters let through."""

    words: Broadcast
    pairs: Broadcast | None
    least: int
    longest: int

    def of(self, s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return windows(s, self.words.value, self.pairs.value if self.pairs is not None else None, self.longest, self.least)


def _borders(docs: DataFrame, step: Step, most: int, rows: int, per_range: int) -> np.ndarray:
    """Range borders from windows of a sample of documents, for ``most`` ranges or as many as the sample asks for.

    They decide the sizes of ranges alone.
    """
    if most <= 1:
        return np.zeros(0, U64)
    share = min(1.0, max(2000, SAMPLE_DOCS * most) / max(rows, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _streams(batches):
            for names, path in step.of(s):
                key = np.unique(range_key(path, 0, names))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    some = docs.where(F.pmod(F.xxhash64(F.lit(12), "t"), F.lit(1 << 31)) < int(share * (1 << 31)))
    keys = Stored(some.mapInArrow(run, "key long"), "border-keys")
    found = keys.df.count()
    ranges = min(most, -(-int(found / share) // per_range))
    distinct = keys.df.distinct()
    thin = distinct.where(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(1 << 31)) < int(min(1.0, SAMPLE_KEYS * ranges / max(found, 1)) * (1 << 31)))
    key = np.sort(np.asarray(thin.toArrow().column("key")).astype(np.int64).view(U64))
    keys.drop()
    if ranges <= 1:
        return np.zeros(0, U64)
    return np.unique(key[np.linspace(0, len(key), ranges + 1)[1:-1].astype(int)]) if len(key) > ranges else key


def _slices(docs: DataFrame, step: Step, borders: Broadcast) -> DataFrame:
    """``part, paths``: the slice of each shard's transducer that a range gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _streams(batches):
            for names, path in step.of(s):
                t = from_places(names, path)
                part = np.searchsorted(borders.value, range_key(t.path, 0, t.names), side="right")
                order = np.argsort(part, kind="stable")  # sorted paths stay sorted within a range
                one, at = np.unique(part[order], return_index=True)
                out = []
                for i, a, b in zip(one.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
                    rows = order[a:b]
                    out.append((i, Transducer(t.names, t.path[rows], t.weight[rows]).pack()))
                    if len(out) == 256:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["part", "paths"])

    return docs.mapInArrow(run, "part long, paths binary")


def _grams(names: np.ndarray) -> pa.Array:
    """Rows of names as binary values of 8 bytes a name, without the empty ones."""
    depth = (names > 0).sum(axis=1)
    data = names[names > 0].astype(">u8").tobytes()
    offset = np.concatenate([[0], np.cumsum(depth * 8)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offset), pa.py_buffer(data)])


def _united(slices: DataFrame, step: Step, borders: Broadcast, frequent: int) -> DataFrame:
    """``l, gram, n`` of the frequent prefixes of ``least`` words or more."""

    def run(table: pa.Table) -> pa.Table:
        whole = [Transducer.unpack(p.as_py()) for p in table.column("paths")]
        while len(whole) > 1:  # a few at a time, so that equal paths are added up early
            whole = [union(whole[i : i + 16]) for i in range(0, len(whole), 16)]
        t = whole[0]
        out = []
        for d in range(step.least, step.longest + 1):
            first, n = t.states(d + 1)
            path = t.names[t.path[first]]
            path[:, d + 1 :] = 0
            split = np.searchsorted(borders.value, range_key(path), side="right") < np.searchsorted(borders.value, range_key(path, 1), side="right")
            kept = split | (n >= frequent)
            path = path[kept]
            out.append(pa.table([pa.array(path[:, 0].view(np.int64)), _grams(path[:, 1:]), pa.array(n[kept])], names=["l", "gram", "n"]))
        return pa.concat_tables(out)

    found = slices.groupBy("part").applyInArrow(run, "l long, gram binary, n long")
    return found.groupBy("l", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)


def _paths(l: pa.Array, gram: pa.Array, longest: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    size = np.asarray(pa.compute.binary_length(gram)).astype(np.int64) // 8
    path = np.zeros((len(size), longest + 1), dtype=U64)
    path[:, 0] = np.asarray(l).astype(np.int64).view(U64)
    names = np.frombuffer(b"".join(gram.to_pylist()), dtype=">u8").astype(U64)
    column = np.arange(longest)
    inside = column < size[:, None]
    path[:, 1:][inside] = names
    if backwards:
        path[:, 1:] = np.where(inside, np.take_along_axis(path[:, 1:], np.maximum(size[:, None] - 1 - column, 0), axis=1), U64(0))
    return path, size


def _parts(grams: DataFrame, backwards: bool, ranges: int, longest: int) -> DataFrame:
    """``l, gram, parts, longer``: counts of the first (last) 1, 2, ... words of every phrase, and the greatest of a word more."""
    spark = grams.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, _ = _paths(b.column("l"), b.column("gram"), longest, backwards)
            yield pa.RecordBatch.from_arrays([pa.array(range_key(path).view(np.int64))], names=["key"])

    borders = np.zeros(0, U64)
    if ranges > 1:
        share = int(min(1.0, SAMPLE_KEYS / RANGE_PHRASES * 4) * (1 << 31))
        some = grams.where(F.pmod(F.xxhash64(F.lit(5), "l", "gram"), F.lit(1 << 31)) < share)
        key = np.sort(np.asarray(some.select("l", "gram").mapInArrow(keys, "key long").toArrow().column("key")).astype(np.int64).view(U64))
        borders = np.unique(key[np.linspace(0, len(key), ranges + 1)[1:-1].astype(int)]) if len(key) > ranges else key
    shared = spark.sparkContext.broadcast(borders)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A phrase goes to its own range and to all that hold phrases which start with it."""
        for b in batches:
            path, _ = _paths(b.column("l"), b.column("gram"), longest, backwards)
            low = np.searchsorted(shared.value, range_key(path), side="right")
            high = np.searchsorted(shared.value, range_key(path, 1), side="right")
            copies = high - low + 1
            row = np.repeat(np.arange(len(path)), copies)
            part = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(part == low[row]), *(b.column(c).take(at) for c in ("l", "gram", "n"))], names=["part", "own", "l", "gram", "n"])

    def composed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        l, gram = (table.column(c).combine_chunks() for c in ("l", "gram"))
        path, size = _paths(l, gram, longest, backwards)
        row = np.arange(len(path))
        t = Transducer.of(path, row)  # the weights tell the order; phrases are distinct
        n, own = np.asarray(table.column("n"))[t.weight], np.asarray(table.column("own"))[t.weight]
        weights, longer = compose(Transducer(t.names, t.path, n), size[t.weight] + 1)
        kept = (size[t.weight] > 1) & (own | (longer > 0))
        size, at = size[t.weight][kept], pa.array(t.weight[kept])
        # Parts of a phrase in another range are found there as well, but given once.
        given = np.where(own[kept], size - 1, 0)
        flat = weights[kept][:, 1:][np.arange(longest) < given[:, None]]
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(given)]).astype(np.int32)), pa.array(flat))
        return pa.table([l.take(at), gram.take(at), parts, pa.array(longer[kept])], names=["l", "gram", "parts", "longer"])

    dealt = grams.select("l", "gram", "n").mapInArrow(deal, "part long, own boolean, l long, gram binary, n long")
    found = dealt.groupBy("part").applyInArrow(composed, "l long, gram binary, parts array<long>, longer long")
    return found.groupBy("l", "gram").agg(F.max("parts").alias("parts"), F.max("longer").alias("longer"))


def _exact(c: Column, digits: int) -> Column:
    return c.cast(f"decimal({digits},0)")


def least_cut(a: str, total: str, firsts: str, lasts: str) -> Column:
    """``score, k, first, last`` of the cut with the least score, from the counts of first and last parts by cut.

    Exact for counts of up to 18 digits in phrases and parts and 16 in totals.
    """
    top = _exact(_exact(F.col(a), 18) * 1000, 21) * _exact(F.col(total), 16)

    def cut(p: Column, k: Column) -> Column:
        score = F.call_function("div", top, _exact(p["first"], 18) * _exact(p["last"], 18))
        return F.struct(score.alias("score"), k.alias("k"), p["first"].alias("first"), p["last"].alias("last"))

    parts = F.arrays_zip(F.col(firsts).alias("first"), F.col(lasts).alias("last"))
    return F.array_min(F.transform(parts, cut))


def phrase_collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", frequent: int = FREQUENT, best: int = BEST, longest: int = LONGEST, words_per_range: int = RANGE, phrases_per_range: int = RANGE_PHRASES
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of two to ``longest`` words of every language.

    ``a`` is the number of occurrences within pieces (at least ``frequent``), ``l`` and ``r`` those of the parts
    of the cut with the least score ``floor(1000 a n / (l r))``, ``n`` the words of the language.  Phrases that a longer
    one holds as often are left out.  Order: score and ``a`` descending, then the phrase.

    A-Z is lower-cased; null texts are empty, a null language is ``und``.  Repeated rows count each; other columns are
    not looked at, so any may be there.  A text of any length is read whole.  Without frequent phrases there are
    no rows.  ``longest`` may be 2 to 5.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    words = Stored(count_words(rows).where(F.col("word").isNull() | (F.col("n") >= frequent)), "frequent-words")
    totals = words.df.where("word IS NULL").select("lang", "l", F.col("n").alias("total"))
    size = totals.agg(F.sum("total").alias("n"), F.count("*").alias("langs")).first()
    single = words.df.where("word IS NOT NULL").select("l", F.unhex(F.lpad(F.hex("name"), 16, "0")).alias("gram"), "n")
    n_rows, most = rows.count(), -(-(size["n"] or 0) // words_per_range)
    known = spark.sparkContext.broadcast(_filter(single, 1))
    found: list[Stored] = []
    for step in [Step(known, None, 2, 2)] + [Step(known, None, 3, longest)] * (longest > 2):
        if found:
            step = step._replace(pairs=spark.sparkContext.broadcast(_filter(found[0].df, 2)))
        borders = spark.sparkContext.broadcast(_borders(rows, step, most, n_rows, words_per_range))
        found.append(Stored(_united(_slices(rows, step, borders), step, borders, frequent), "frequent-phrases"))
        release(spark)
    every = single
    for f in found:
        every = every.unionByName(f.df)
    grams = Stored(every, "all-phrases")

    ranges = -(-grams.df.count() // phrases_per_range)
    first = Stored(_parts(grams.df, False, ranges, longest), "first-parts")
    last = Stored(_parts(grams.df, True, ranges, longest), "last-parts")
    f, b = first.df.alias("f"), last.df.alias("b")
    both = f.join(b, ["l", "gram"]).join(grams.df, ["l", "gram"]).where(F.greatest("f.longer", "b.longer") < F.col("n"))
    both = both.select("l", "gram", F.col("n").alias("a"), F.col("f.parts").alias("firsts"), F.reverse("b.parts").alias("lasts"))
    small = F.broadcast(totals) if size["langs"] <= BROADCAST_LANGUAGES else totals
    both = both.join(small, "l")
    scored = both.withColumn("cut", least_cut("a", "total", "firsts", "lasts")).select("lang", "l", "gram", "a", F.col("total").alias("n"), "cut.score", F.col("cut.first").alias("first"), F.col("cut.last").alias("last"))
    scored = Stored(scored, "scored-phrases")

    # The best by numbers alone, with all ties, in two steps so that no language goes to one task whole.
    order = [F.desc("score"), F.desc("a")]
    near = scored.df.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
    near = near.withColumn("at", F.rank().over(Window.partitionBy("l", "salt").orderBy(*order))).where(F.col("at") <= best)
    near = Stored(near.withColumn("at", F.rank().over(Window.partitionBy("l").orderBy(*order))).where(F.col("at") <= best).drop("at", "salt"), "best-phrases")
    each = near.df.select("l", "gram", F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("gram") / 8 - 1).cast("int")), lambda i: F.substring(F.col("gram"), i * 8 + 1, F.lit(8)))).alias("at", "name"))
    each = each.withColumn("name", F.conv(F.hex("name"), 16, -10).cast("long"))
    named = each.join(words.df.where("word IS NOT NULL").select("l", "name", "word"), ["l", "name"])
    text_of = named.groupBy("l", "gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = near.df.join(text_of, ["l", "gram"])
    rank = F.row_number().over(Window.partitionBy("l").orderBy(*order, F.asc("phrase")))
    out = out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)
    result = Stored(out.select("lang", "rank", "phrase", "a", F.col("first").alias("l"), F.col("last").alias("r"), "n", "score"), "phrases")
    for t in (words, *found, grams, first, last, scored, near):
        t.drop()
    release(spark)
    return result.df
