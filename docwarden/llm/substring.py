"""Removal of word passages that occurred earlier, by compressed FM-indexes over shards of candidate segments.

A window is ``length`` consecutive words.  Its anchor is the least of the hashes of its 8-word runs, so equal
windows have equal anchors, and neighbouring windows mostly share theirs.  Consecutive windows with one anchor
form a segment.

1. Anchors that occur at one place only cannot hold a repeated window; counting them drops most of the text.
2. Segments with equal words are reduced to the earliest one; in the others every window is a repeat.
3. The remaining segments go to shards by anchor.  Each shard is indexed; backward search over the wavelet tree finds
   the windows that occur in it twice or more, and all but the earliest of each are repeats.  Anchors with very many
   different segments (the surroundings of a common passage) are not indexed: their windows are segments of their own,
   reduced to the earliest one as in step 2.
4. Words under repeated windows are cut from the documents.

A shard is the part of a task's anchors that has about ``SHARD_WORDS`` words, and no shard depends on one
anchor's or window's frequency: the earliest of equal windows is found by tasks' own minima, and the others by a join
that streams and that Spark splits.  Documents are moved once, into a table bucketed by document, and read from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FmIndex
from .stored import Stored, partitions, release
from .text_bytes import U64, mix64, row_chunks, runs, sliding_least, words_of

WINDOW = 20
GRAM = 8
SHARD_WORDS = 300_000
#: Different segments of an anchor beyond which its windows are taken singly.
HOT_SEGMENTS = 20_000


def _segments(name: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all rows' words: anchor, row, start in the row and number of windows of each segment."""
    gram = min(GRAM, length)
    grams = runs(name, gram)
    least = sliding_least(grams, length - gram + 1)
    rows = np.diff(first)
    windows = np.maximum(rows - length + 1, 0)
    row = np.repeat(np.arange(len(rows)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = least[first[row] + inside] if len(row) else np.zeros(0, U64)
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    if len(row):  # past the place of its anchor a segment ends, so no segment holds a window twice
        fresh[1:] |= (grams[first[row] + inside] == anchor)[:-1]
    at = np.flatnonzero(fresh)
    return anchor[at], row[at], inside[at], np.diff(np.append(at, len(row)))


def _row_names(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's whole sequence of words."""
    count = np.diff(first)
    place = np.arange(len(name)) - np.repeat(first[:-1], count)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(name ^ mix64(place.astype(U64))), dtype=U64)])
        return mix64(run[first[1:]] - run[first[:-1]] + count.astype(U64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            w = words_of(batch.column("_text"))
            anchor, row, start, _ = _segments(w.name, w.first, length)
            same = _row_names(w.name, w.first)
            with np.errstate(over="ignore"):
                place = mix64(same[row] + start.astype(U64)).astype(np.uint32).view(np.int32)
            doc, key = (batch.column(c).take(pa.array(row)) for c in ("_doc", "_key"))
            yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(place), doc, key, _signed(same[row])], names=["anchor", "place", "_doc", "_key", "same"])

    return docs.select("_doc", "_key", "_text").mapInArrow(run, "anchor long, place int, _doc long, _key long, same long")


def _segment_rows(table: DataFrame, length: int) -> DataFrame:
    """Segments with a repeated anchor, with a hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            w = words_of(batch.column("_text"))
            anchor, row, start, windows = _segments(w.name, w.first, length)
            lists = batch.column("anchors")
            known = np.asarray(lists.flatten()).view(U64)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            with np.errstate(over="ignore"):
                hit = np.isin(mix64(anchor + mix64(row.astype(U64))), mix64(known + mix64(owner.astype(U64))))
                anchor, row, start, windows = anchor[hit], row[hit], start[hit], windows[hit]
                run_sum = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(runs(w.name, length)), dtype=U64)])
                at = w.first[row] + start
                content = mix64(run_sum[at + windows] - run_sum[at] + windows.astype(U64)) if len(at) else anchor
            doc, key = (batch.column(c).take(pa.array(row)) for c in ("_doc", "_key"))
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(content), doc, key, pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                names=["anchor", "content", "_doc", "_key", "start", "windows"],
            )

    return table.mapInArrow(run, "anchor long, content long, _doc long, _key long, start int, windows int")


def _contents(table: DataFrame, length: int) -> DataFrame:
    """The words of the segments in ``pieces``, dealt by ``shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            w = words_of(batch.column("_text"))
            out: dict[str, list] = {c: [] for c in ("shard", "_doc", "_key", "start", "words")}
            for i, pieces in enumerate(batch.column("pieces").to_pylist()):
                doc, key = batch.column("_doc")[i].as_py(), batch.column("_key")[i].as_py()
                name = w.name[w.first[i] : w.first[i + 1]]
                for p in pieces:
                    start = p["start"]
                    out["shard"].append(p["anchor"]), out["_doc"].append(doc), out["_key"].append(key), out["start"].append(start)
                    out["words"].append(name[start : start + p["windows"] + length - 1].tobytes())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return table.mapInArrow(run, "shard long, _doc long, _key long, start int, words binary")


def _single_windows(table: DataFrame, length: int) -> DataFrame:
    """Each window of the segments in ``pieces``, named by a hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            w = words_of(batch.column("_text"))
            lists = batch.column("pieces")
            flat = lists.flatten()
            begin, windows = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "windows"))
            row = np.repeat(np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths())), windows)
            start = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(len(row))
            doc, key = (batch.column(c).take(pa.array(row)) for c in ("_doc", "_key"))
            name = runs(w.name, length)[w.first[row] + start]
            yield pa.RecordBatch.from_arrays([_signed(name), doc, key, pa.array(start.astype(np.int32))], names=["window", "_doc", "_key", "start"])

    return table.mapInArrow(run, "window long, _doc long, _key long, start int")


def _index_shards(contents: DataFrame, length: int, shard_words: int) -> DataFrame:
    """``_key, start, windows``: windows of a shard that occurred earlier in it, as runs of consecutive starts."""

    def search(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        doc, key, start = (np.asarray(t.column(c)) for c in ("_doc", "_key", "start"))
        order = np.lexsort((start, key, doc))
        doc, key, start = doc[order], key[order], start[order]
        words = t.column("words").take(pa.array(order)).to_pylist()
        counts = np.array([len(x) // 8 for x in words])
        names, ids = np.unique(np.frombuffer(b"".join(words), dtype=U64), return_inverse=True)
        # Each segment is followed by a border, the number 0.
        upto = np.cumsum(counts + 1)
        sequence = np.zeros(upto[-1], dtype=np.int64)
        inner = np.ones(upto[-1], dtype=bool)
        inner[upto - 1] = False
        sequence[inner] = ids + 1
        windows = counts - length + 1
        segment = np.repeat(np.arange(len(counts)), windows)
        inside = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        found, run = FmIndex(sequence, len(names) + 1, length).repeated(sequence, (upto - counts - 1)[segment] + inside, length)
        # Windows are in the order of documents and starts, so the first of each range is the earliest.
        first = np.unique(run, return_index=True)[1]
        later = np.ones(len(found), dtype=bool)
        later[first] = False
        found = np.sort(found[later])
        fresh = np.ones(len(found), dtype=bool)
        fresh[1:] = (np.diff(found) != 1) | (segment[found[1:]] != segment[found[:-1]])
        at = np.flatnonzero(fresh)
        begin = found[at]
        length_of = np.diff(np.append(at, len(found)))
        return pa.RecordBatch.from_arrays(
            [pa.array(key[segment[begin]]), pa.array((start[segment[begin]] + inside[begin]).astype(np.int32)), pa.array(length_of.astype(np.int32))],
            names=["_key", "start", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in row_chunks(batches, "words", shard_words * 4):
            shard = np.asarray(batch.column("shard"))
            cut = 0
            if size >= shard_words * 8 and held:  # close the shard where the next anchor begins
                last = held[-1].column("shard")[-1].as_py()
                other = np.flatnonzero(shard != last)
                if len(other):
                    cut = int(other[0])
                    yield search(held + ([batch.slice(0, cut)] if cut else []))
                    held, size = [], 0
            held.append(batch.slice(cut))
            size += held[-1].nbytes
        if held:
            yield search(held)

    dealt = contents.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "_key long, start int, windows int")


def remove_repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW, kept: str = "kept_text", shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS
) -> DataFrame:
    """Add ``kept``, the words left joined by one blank, and ``n_words``, ``n_removed`` and ``removed_spans``.

    A word goes if one of its windows of ``length`` words starts earlier too: in a document with a smaller
    ``key``, or before in its own.  All windows are judged on the input.  Null texts and texts without words keep
    an empty text.  Rows without a key come after all others.  Rows with one key and equal texts are one
    document; if their texts differ, they are ordered by a hash.  ``removed_spans`` are first words and numbers of
    windows, unordered.  All rows and other columns are kept; columns with a new one's name are replaced.
    """
    spark = docs.sparkSession
    new = [kept, "n_words", "n_removed", "removed_spans"]
    base = docs.drop(*new)
    columns = list(base.columns)
    b = partitions(spark)
    keyed = base.withColumns({"_doc": F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), "_key": F.xxhash64(F.col(key), F.col(text)), "_text": F.coalesce(text, F.lit(""))})

    # 1. Anchors at two places or more; copies of a whole text count as one place.
    anchors = Stored(_anchor_rows(keyed, length), "anchors")
    rows = anchors.df
    texts = rows.select("_doc", "_key", "same").distinct()
    # Counts are written before they are joined, so that Spark can split the rows of a common key among tasks.
    earliest = Stored(texts.groupBy("same").agg(F.min(F.struct("_doc", "_key")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "earliest")
    copies = texts.join(earliest.df, "same").where(F.struct("_doc", "_key") > F.col("first")).select("_key")
    again = Stored(rows.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("anchor"), "repeated-anchors")
    hits = rows.select("anchor", "_key").join(again.df, "anchor", "left_semi").groupBy("_key").agg(F.collect_set("anchor").alias("anchors"))
    marks = hits.withColumn("copy", F.lit(False)).unionByName(copies.withColumns({"anchors": F.array().cast("array<long>"), "copy": F.lit(True)}))
    marks = Stored(marks.groupBy("_key").agg(F.max("copy").alias("copy"), F.flatten(F.collect_list("anchors")).alias("anchors")), "anchor-lists")
    del rows, texts, copies, hits
    for t in (anchors, earliest, again):
        t.drop()
    release(spark)

    # Documents with their repeated anchors, moved once.
    table = Stored(keyed.drop("_text").repartition(b, "_key").join(marks.df.hint("shuffle_merge"), "_key", "left"), "documents-by-key", b, "_key")
    marks.drop()
    suspects = table.df.where("NOT copy AND size(anchors) > 0").withColumn("_text", F.col(text))

    # 2. The earliest of equal segments.
    segments = Stored(_segment_rows(suspects.select("_doc", "_key", "_text", "anchors"), length), "segments")
    place = F.struct("_doc", "_key", "start")
    firsts = Stored(segments.df.groupBy("anchor", "content", "windows").agg(F.min(place).alias("first")), "first-segments")
    later = segments.df.join(firsts.df, ["anchor", "content", "windows"]).where(place > F.col("first")).select("_key", "start", "windows")
    often = Stored(firsts.df.groupBy("anchor").count(), "anchor-counts")
    compared = firsts.df.join(often.df.where("count > 1"), "anchor").withColumn("hot", F.col("count") > hot_segments)

    # 3. Different segments of one anchor, searched in shards; those of hot anchors window by window as in step 2.
    def with_pieces(hot: bool) -> DataFrame:
        pieces = compared.where(F.col("hot") == hot).select("first._key", F.struct("first.start", "windows", "anchor").alias("p"))
        pieces = pieces.groupBy("_key").agg(F.collect_list("p").alias("pieces"))
        return suspects.select("_doc", "_key", "_text").join(pieces, "_key")

    singles = []
    if not often.df.where(F.col("count") > max(hot_segments, 1)).isEmpty():
        windows = Stored(_single_windows(with_pieces(True), length), "hot-windows")
        earliest = Stored(windows.df.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-windows")
        repeats = windows.df.join(earliest.df, "window").where(place > F.col("first"))
        later = later.unionByName(repeats.select("_key", "start", F.lit(1).alias("windows")))
        singles = [windows, earliest]
    indexed = _index_shards(_contents(with_pieces(False), length), length, shard_words)
    cuts = later.unionByName(indexed).groupBy("_key").agg(F.collect_list(F.struct("start", "windows")).alias("removed_spans"))
    cuts = Stored(cuts, "cuts")
    repeats = None
    del later, compared, with_pieces, indexed
    for t in (segments, firsts, often, *singles):
        t.drop()
    release(spark)

    # 4. Cut.
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
    spans = "array<struct<start:int,windows:int>>"
    done = table.df.join(cuts.df, "_key", "left").select(*(F.col(f"`{c}`") for c in columns), "copy", F.coalesce("removed_spans", F.array().cast(spans)).alias("removed_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, text):
            w = words_of(batch.column(text))
            n_words = np.diff(w.first)
            gone = np.zeros(len(w.name) + 1, dtype=np.int64)
            lists = batch.column("removed_spans")
            flat = lists.flatten()
            start, windows = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("windows")).astype(np.int64)
            begin = start + np.repeat(w.first[:-1], np.asarray(lists.value_lengths()))
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + windows + length - 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            whole = np.asarray(batch.column("copy").fill_null(False)) & (n_words >= length)
            gone |= np.repeat(whole, n_words)
            run = np.concatenate([[0], np.cumsum(gone)])
            removed = run[w.first[1:]] - run[w.first[:-1]]
            texts = []
            data = w.data.tobytes()
            for i in range(batch.num_rows):
                at = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
                texts.append(b" ".join([data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]))
            arrays = [*(batch.column(c) for c in columns), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words), pa.array(removed), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *new])

    return done.mapInArrow(cut, ", ".join([*fields, f"`{kept}` string, n_words long, n_removed long, removed_spans {spans}"]))
