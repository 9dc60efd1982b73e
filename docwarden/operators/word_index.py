"""A stored word index that grows: segments of postings in blocks, best-first search, deletions by bitmap.

``<path>/_versions`` names the segments (:mod:`docwarden.sources.snapshots`).  A segment deals its documents over shards by the
hash of their id, the only exchange of a build; a document travels as its distinct words and their counts.  A
shard is a bounded run of documents in the order of their ids, which gives each a place.  A word's postings in a shard
are rows of up to :data:`BLOCK` places, as differences in the narrowest type, with the word's counts, the documents'
lengths, and the greatest count and least length among them, from which the best possible score follows.

A search reads the blocks of its words and scores shard by shard.  The places of a shard fall into stretches between
block borders; each has a bound, the sum of what its blocks could give.  Stretches are taken best first, and only
those whose bound reaches the score of the query's k-th document so far are decoded.

Statistics of the whole corpus (documents, words, documents per word) are sums over segments less those of deleted
documents; they are added up when a version is first searched, and kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarden.operators.scoring import UNIT, Shard, counted_words, let_go, pack_runs, places_of, unpack_runs, unpacked_words
from docwarden.operators.search import CorpusStats, corpus_stats, only_best, query_groups, sent_queries, small, term_weights, weighted_queries
from docwarden.scratch import materialise
from docwarden.sources import snapshots

#: Postings and documents of a shard, places of a block, and documents that a partition should hold about.
SHARD_POSTINGS, SHARD_DOCS, BLOCK, DOCS_PER_PARTITION = 4_000_000, 100_000, 512, 100_000
#: Bytes of a shard's different words; documents that are taken apart, postings that are cut into blocks, and rows that are handed on at once.
SHARD_BYTES, PIECE_DOCS, CUT_POSTINGS, OUT_ROWS = 64 << 20, 1024, 1 << 17, 4096
#: Blocks whose postings are looked up among the deleted documents at once.
LOST_BLOCKS = 1024
#: Up to this many words are handed to the file reader, which then skips what holds none of them.
MAX_PUSHED_WORDS = 100
_BLOCKS = "shard long, token string, block int, n int, first int, last int, most int, least int, places binary, counts binary, lengths binary"
# ---------------------------------------------------------------------------------------------
# Building


class _Postings:
    """What a task holds of a shard until it is whole: words as codes of the dictionary of their piece, and counts."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.dl: list[np.ndarray] = []
        self.per_doc: list[np.ndarray] = []
        self.coded: list[pa.DictionaryArray] = []
        self.counts: list[np.ndarray] = []
        self.docs = self.size = self.bytes = 0

    def add(self, piece: pa.RecordBatch) -> None:
        words, counts = unpacked_words(piece)
        self.ids.append(pa.concat_arrays([piece.column("id")]))  # a copy, so that the batch can go
        self.dl.append(np.array(piece.column("dl"), np.int32))
        self.per_doc.append(np.array(piece.column("n"), np.int32))
        self.coded.append(words.dictionary_encode())
        self.counts.append(counts.astype(np.min_scalar_type(counts.max(initial=0))))
        self.docs += piece.num_rows
        self.size += len(counts)
        self.bytes += self.coded[-1].dictionary.nbytes

    @property
    def full(self) -> bool:
        return self.size >= SHARD_POSTINGS or self.docs >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def rows(self, shard: int, block: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row per document, then block rows by word; words are let go as they are coded, and blocks are cut for a run of words at once."""
        ids, dl = pa.concat_arrays(self.ids), np.concatenate(self.dl).astype(np.int64)
        for at in range(0, self.docs, OUT_ROWS):
            part = ids.slice(at, OUT_ROWS)
            yield _filled({"shard": np.full(len(part), shard), "first": np.arange(at, at + len(part)), "n": dl[at : at + len(part)], "id": part}, len(part), arrow)
        if not self.size:
            return
        coded = pa.chunked_array(self.coded).unify_dictionaries()
        self.coded.clear()
        words = coded.chunk(0).dictionary
        let_go()
        by_name = np.asarray(pa.compute.array_sort_indices(words)).astype(np.int32)
        rank = np.empty(len(by_name), np.int32)
        rank[by_name] = np.arange(len(by_name), dtype=np.int32)
        # Postings by word, and of a word by place: sorted as one number each.
        bits = self.size.bit_length()
        key, per_word, done = np.empty(self.size, np.int64), np.zeros(len(words), np.int64), 0
        for chunk in coded.chunks:
            code = rank[np.asarray(chunk.indices)]
            per_word += np.bincount(code, minlength=len(words))
            key[done : done + len(code)] = (code.astype(np.int64) << bits) + np.arange(done, done + len(code))
            done += len(code)
        del coded, chunk, rank
        ends = np.cumsum(per_word)
        key.sort()
        place, counts = np.repeat(np.arange(self.docs, dtype=np.int32), np.concatenate(self.per_doc)), np.concatenate(self.counts)
        self.counts.clear()
        word = 0
        while word < len(words):
            start = int(ends[word - 1]) if word else 0
            after = max(word + 1, int(np.searchsorted(ends, start + CUT_POSTINGS, side="right")))
            order = key[start : ends[after - 1]] & ((1 << bits) - 1)
            rows = _block_rows(shard, words.take(pa.array(by_name[word:after])), per_word[word:after], place[order].astype(np.int64), counts[order].astype(np.int64), dl, block, arrow)
            for at in range(0, rows.num_rows, OUT_ROWS):
                yield rows.slice(at, OUT_ROWS)
            word = after


def _filled(made: dict, n: int, arrow: pa.Schema) -> pa.RecordBatch:
    """Rows of these columns; the others are NULL."""
    columns = (made.get(f.name) for f in arrow)
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, arrow)], schema=arrow)


def _block_rows(shard: int, words: pa.Array, per_word: np.ndarray, place: np.ndarray, counts: np.ndarray, dl: np.ndarray, block: int, arrow: pa.Schema) -> pa.RecordBatch:
    """Block rows of these words of one shard, whose postings come by word and place."""
    lengths = dl[place]
    many = -(-per_word // block)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts = np.append(np.repeat(np.cumsum(per_word) - per_word, many) + number * block, len(place))
    first = place[starts[:-1]]
    gaps = np.diff(place, prepend=0)
    gaps[starts[:-1]] = 0
    made = {
        "shard": np.full(len(first), shard), "token": words.take(pa.array(np.repeat(np.arange(len(words)), many))), "block": number, "n": np.diff(starts), "first": first, "last": place[starts[1:] - 1],
        "most": np.maximum.reduceat(counts, starts[:-1]), "least": np.minimum.reduceat(lengths, starts[:-1]), "places": pack_runs(gaps, starts), "counts": pack_runs(counts, starts), "lengths": pack_runs(lengths, starts),
    }
    return _filled(made, len(first), arrow)


def _inverted_batches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows of the shards of one partition, whose documents come by id."""
    arrow, made, held = None, 0, _Postings()
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [p.split(" ") for p in _BLOCKS.split(", ")]

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal made, held
        yield from held.rows((part << 32) + made, block, arrow)
        made, held = made + 1, _Postings()
        let_go()

    for batch in batches:
        if arrow is None:
            arrow = pa.schema([*((a, kinds[b]) for a, b in pairs), ("id", batch.schema.field("id").type)])
        for at in range(0, batch.num_rows, PIECE_DOCS):
            part = batch.column("part")[at].as_py()
            held.add(batch.slice(at, PIECE_DOCS))
            if held.full:
                yield from close()
    if held.docs:
        yield from close()


def _inverted(counted: DataFrame, partitions: int, block: int) -> DataFrame:
    """Block rows, and a row per document (``token`` null, ``first`` its place, ``n`` its length, ``id``)."""
    # The exchange: by document, so that a word of most documents lies in all shards alike.
    dealt = counted.repartition(partitions, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    schema = T.StructType([*T.StructType.fromDDL(_BLOCKS), counted.schema["id"]])
    return dealt.mapInArrow(lambda batches: _inverted_batches(batches, block), schema)


def _write_segment(docs: DataFrame, path: str, block: int) -> dict:
    spark = docs.sparkSession
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    counted = materialise(counted_words(docs), "counted-words")
    n_docs, n_words, postings = counted.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # About one shard a partition, so that a task sorts few documents at once.
    partitions = max(1, -(-n_docs // DOCS_PER_PARTITION), -(-4 * postings // (3 * SHARD_POSTINGS)), min(spark.sparkContext.defaultParallelism, -(-n_docs // 1000)))
    # Not partitioned by kind, which would sort all rows of a task before they are written.
    _inverted(counted, partitions, block).write.parquet(f"{at}/rows")
    segment = {"name": name, "docs": n_docs, "words": n_words, "id": counted.schema["id"].dataType.simpleString(), "deleted": None}
    _rows(spark, path, segment, "blocks").groupBy("token").agg(F.sum("n").alias("df")).write.parquet(f"{at}/terms")
    return segment


def build_index(docs: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write an index of ``docs(id, content)`` at ``path``, where there is none yet."""
    snapshots.publish(docs.sparkSession, path, 0, {"segments": [_write_segment(docs, path, block)]})


def add_documents(docs: DataFrame, path: str, block: int = BLOCK) -> None:
    """Add documents as a segment of their own; segments that others add meanwhile stay."""
    segment = _write_segment(docs, path, block)
    snapshots.change(docs.sparkSession, path, lambda version, content: {"segments": [*content.get("segments", []), segment]})


def _rows(spark: SparkSession, path: str, segment: dict, kind: str) -> DataFrame:
    """Rows of ``blocks`` or of ``docs``; older segments have a folder for either."""
    schema = T.StructType([*T.StructType.fromDDL(_BLOCKS), *T.StructType.fromDDL(f"id {segment['id']}")])
    rows = spark.read.schema(schema).parquet(f"{path}/segments/{segment['name']}/rows").select(*schema.names)
    return rows.where(F.col("token").isNotNull() if kind == "blocks" else F.col("token").isNull())


def _bitmaps(spark: SparkSession, path: str, segment: dict) -> DataFrame:
    """``shard, gone``: a bit per place of a shard's deleted documents; shards without any have no row."""
    if segment["deleted"] is None:
        return spark.createDataFrame([], "shard long, gone binary")
    return spark.read.schema("shard long, gone binary").parquet(f"{path}/deleted/{segment['deleted']['name']}/bitmaps")


def _as_bitmap(table: pa.Table) -> pa.Table:
    places = np.concatenate([np.asarray(table.column("first").combine_chunks()).astype(np.int64)])
    bits = np.zeros(int(places.max()) // 8 * 8 + 8, dtype=np.uint8)
    bits[places] = 1
    return pa.table([table.column("shard").slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["shard", "gone"])


def _lost_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a block whose documents are gone; many blocks at once, as most hold a single posting."""
    for whole in batches:
        for start in range(0, whole.num_rows, LOST_BLOCKS):
            batch = whole.slice(start, LOST_BLOCKS)
            gaps, starts = unpack_runs(batch.column("places"))
            n, place = np.diff(starts), np.cumsum(gaps)
            place += np.repeat(np.asarray(batch.column("first")) - place[starts[:-1]], n)
            bitmap = batch.column("gone").dictionary_encode()
            bits = [np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little") for b in bitmap.dictionary.to_pylist()]
            size = np.array([len(b) for b in bits])
            shard = np.repeat(np.asarray(bitmap.indices), n)
            known = np.flatnonzero(place < size[shard])  # a bitmap ends with its last document
            gone = np.zeros(len(place), np.int64)
            gone[known] = np.concatenate(bits)[(np.cumsum(size) - size)[shard[known]] + place[known]]
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(np.add.reduceat(gone, starts[:-1]))], names=["token", "df"])


def remove_documents(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Take the documents of ``ids(id)`` out of the index: bits for their places, and what they gave to the statistics."""

    def make(version: int, content: dict) -> dict | None:
        segments = []
        for segment in content["segments"]:
            docs = _rows(spark, path, segment, "docs").select("shard", "first", "n", "id")
            hit = docs.join(ids.select("id").distinct(), "id", "left_semi")
            before = _bitmaps(spark, path, segment)
            if segment["deleted"] is not None:
                gone = before.mapInArrow(_places, "shard long, first int")
                hit = hit.unionByName(docs.join(gone, ["shard", "first"])).distinct()
            hit = materialise(hit, "removed")
            size = hit.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
            if size["docs"] == (segment["deleted"] or {"docs": 0})["docs"]:
                segments.append(segment)
                continue
            name = uuid.uuid4().hex
            hit.select("shard", "first").groupBy("shard").applyInArrow(_as_bitmap, "shard long, gone binary").write.parquet(f"{path}/deleted/{name}/bitmaps")
            segment = segment | {"deleted": {"name": name, "docs": size["docs"], "words": size["words"]}}
            touched = _rows(spark, path, segment, "blocks").join(_bitmaps(spark, path, segment), "shard")
            lost = touched.select("token", "first", "places", "gone").mapInArrow(_lost_words, "token string, df long")
            lost.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(f"{path}/deleted/{name}/terms")
            segments.append(segment)
        return None if segments == content["segments"] else {"segments": segments}

    snapshots.change(spark, path, make)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, gone in zip(batch.column("shard").to_pylist(), batch.column("gone").to_pylist()):
            place = places_of(gone).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), shard)), pa.array(place)], names=["shard", "first"])


# ---------------------------------------------------------------------------------------------
# Statistics of a version


def statistics(spark: SparkSession, path: str) -> tuple[dict, CorpusStats, DataFrame]:
    """The last version's content, its corpus statistics and word weights; added up once a version."""
    version, content = snapshots.latest(spark, path)
    if not version:
        raise FileNotFoundError(f"no index at {path}")
    segments = content["segments"]
    minus = [s["deleted"] for s in segments if s["deleted"] is not None]
    n_docs, n_words = (sum(s[k] for s in segments) - sum(m[k] for m in minus) for k in ("docs", "words"))
    published = f"{path}/merged/{version:08d}"
    found, kept = snapshots.latest(spark, published)
    if not found:
        terms = "token string, df long"
        added = spark.read.schema(terms).parquet(*[f"{path}/segments/{s['name']}/terms" for s in segments])
        if minus:
            lost = spark.read.schema(terms).parquet(*[f"{path}/deleted/{m['name']}/terms" for m in minus])
            added = added.unionByName(lost.withColumn("df", -F.col("df")))
        name = uuid.uuid4().hex
        added.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(f"{path}/merged/{name}")
        total = spark.createDataFrame([(None, n_docs, n_words)], "token string, df long, n_words long")
        vocab = spark.read.schema(terms).parquet(f"{path}/merged/{name}")
        s = corpus_stats(vocab.withColumn("n_words", F.lit(None).cast("long")).unionByName(total)) if n_docs else CorpusStats(0, 0.0, 0.0, 0)
        kept = {"terms": name, "n_docs": s.n_docs, "avg_words": s.avg_words, "mean_weight": s.mean_weight, "n_terms": s.n_terms}
        try:
            snapshots.publish(spark, published, 0, kept)
        except snapshots.Conflict:  # another search has added them up as well
            kept = snapshots.latest(spark, published)[1]
    stats = CorpusStats(kept["n_docs"], kept["avg_words"], kept["mean_weight"], kept["n_terms"])
    return content, stats, term_weights(spark.read.schema("token string, df long").parquet(f"{path}/merged/{kept['terms']}"), stats)


# ---------------------------------------------------------------------------------------------
# Searching


def _shard_of(table: pa.Table, avg: float) -> tuple[int, int, Shard]:
    rows = table.to_pylist()
    head = next(r for r in rows if r["token"] is None)
    blocks = [r for r in rows if r["token"] is not None]
    return head["segment"], head["shard"], Shard(blocks, places_of(head["places"]), head["n"], avg)


def _search(shards: DataFrame, weighted: DataFrame, avg: float, k: int, whole: bool, qid: T.StructField) -> DataFrame:
    """``qid, segment, shard, at, units``: the best of every shard, and ``decoded, total`` postings on rows without ``qid``."""
    shared, kind = sent_queries(weighted)

    def run(table: pa.Table) -> pa.Table:
        segment, number, shard = _shard_of(table, avg)
        qids, place, units = shard.answers(shared.value, k, whole)
        decoded, total = shard.decoded, shard.total
        del shard
        let_go()
        n = len(qids)
        out = [pa.array([*qids, None], kind), pa.array([segment] * (n + 1), pa.int32()), pa.array([number] * (n + 1), pa.int64()), pa.array(np.append(place, 0).astype(np.int32))]
        cost = [pa.array([*[None] * n, x], pa.int64()) for x in (decoded, total)]
        return pa.table([*out, pa.array(np.append(units, 0)), *cost], names=["qid", "segment", "shard", "at", "units", "decoded", "total"])

    schema = T.StructType([T.StructField("qid", qid.dataType), *T.StructType.fromDDL("segment int, shard long, at int, units long, decoded long, total long")])
    return shards.groupBy("segment", "shard").applyInArrow(run, schema)


def _needed(spark: SparkSession, path: str, segments: list[dict], words: DataFrame) -> DataFrame:
    """Blocks of these words, and a row per shard with its number of documents and its bitmap."""
    few = [r["token"] for r in words.limit(MAX_PUSHED_WORDS + 1).collect()]
    out = None
    for i, segment in enumerate(segments):
        blocks = _rows(spark, path, segment, "blocks")
        blocks = blocks.where(F.col("token").isin(few)) if len(few) <= MAX_PUSHED_WORDS else blocks.join(small(words), "token", "left_semi")
        size = _rows(spark, path, segment, "docs").groupBy("shard").agg((F.max("first") + 1).cast("int").alias("n"))
        heads = size.join(_bitmaps(spark, path, segment), "shard", "left").select("shard", "n", F.col("gone").alias("places"))
        both = blocks.drop("id").unionByName(heads, allowMissingColumns=True).withColumn("segment", F.lit(i))
        out = both if out is None else out.unionByName(both)
    return out


def _found(spark: SparkSession, path: str, queries: DataFrame, k: int) -> tuple[dict, DataFrame]:
    content, stats, weights = statistics(spark, path)
    qid = queries.schema["qid"]
    asked = materialise(weighted_queries(queries, weights), "query-weights")
    found: DataFrame | None = None
    for part in query_groups(asked):
        shards = _needed(spark, path, content["segments"], part.where("token IS NOT NULL").select("token").distinct())
        best = materialise(_search(shards, part, stats.avg_words, k, False, qid), "found")
        # Queries with fewer than k documents above zero take some at zero, and then below.
        full = best.where("qid IS NOT NULL").groupBy("qid").count().where(F.col("count") >= k)
        short = materialise(part.join(full, "qid", "left_anti"), "short-queries")
        if not short.isEmpty():
            shards = _needed(spark, path, content["segments"], short.where("token IS NOT NULL").select("token").distinct())
            rest = materialise(_search(shards, short, stats.avg_words, k, True, qid), "found")
            best = best.join(short.select("qid").distinct(), "qid", "left_anti").unionByName(rest)
        found = best if found is None else found.unionByName(best)
    return content, found


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(qid, rank, id, score)``: the ``k`` best documents of every query, as ``bm25_topk`` gives for the indexed documents."""
    content, found = _found(spark, path, queries, k)
    kind = content["segments"][0]["id"]
    if found is None:
        return spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank int, id {kind}, score double")
    near = found.where("qid IS NOT NULL").withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("units"))))
    near = small(materialise(near.where(F.col("r") <= k).select("qid", "segment", "shard", "at", "units"), "near"))
    docs = None
    for i, segment in enumerate(content["segments"]):
        ids = _rows(spark, path, segment, "docs").select(F.lit(i).alias("segment"), "shard", F.col("first").alias("at"), "id")
        docs = ids if docs is None else docs.unionByName(ids)
    named = docs.join(near, ["segment", "shard", "at"])
    return only_best(named, "units", k).select("qid", "rank", "id", (F.col("units") / UNIT).alias("score"))


def search_cost(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """``decoded, total``: postings that a search decodes, of those of its words."""
    _, found = _found(spark, path, queries, k)
    return found.where("qid IS NULL").agg(F.sum("decoded").alias("decoded"), F.sum("total").alias("total"))
