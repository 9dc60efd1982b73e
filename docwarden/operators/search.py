"""Ranked retrieval over a corpus ``(id, content)``: BM25 on words, cosine on vectors.

Queries are a frame ``(qid, text)``, so many run in one job.  Ties go to the lower ``id``.
"""

from __future__ import annotations

import functools
import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from docwarden.functions import text as tx
from docwarden.functions.shaping import explode_once
from docwarden.functions.vectors import NORM_FLOOR
from docwarden.operators.scoring import UNIT, Run, counted_batches, words_of
from docwarden.scratch import materialise
from docwarden.sources import snapshots

logger = logging.getLogger(__name__)

DEFAULT_TOP_K = 5
# Fixed value: a negative weight becomes this times the mean weight.
FLOOR = 0.25
# Words and counts of the documents that a task scores at once, in bytes.
RUN_BYTES = 32 << 20
# Query words are broadcast up to this many rows (some 50 MB).
MAX_BROADCAST_ROWS = 500_000


# ---------------------------------------------------------------------------------------------
# Words


def token_stats(docs: DataFrame) -> DataFrame:
    tokens = docs.select("id", tx.tokenise(F.col("content")).alias("tokens"))
    return tokens.select(
        "id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct")
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """Documents per word, ``(token, df, n_words)``, in one pass.

    The row with a NULL token counts the documents and their words.  Counting starts before the
    shuffle, so frequent words cost one row per task.
    """
    tokens = docs.select(tx.tokenise(F.col("content")).alias("tokens"))
    each = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    return (
        tokens.select(F.size("tokens").cast("long").alias("dl"), F.explode_outer(each).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("dl"))).alias("n_words"))
    )


@dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    avg_words: float
    mean_weight: float
    n_terms: int


def _raw_weight(df: Column, n_docs: Column | int) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_stats(vocab: DataFrame) -> CorpusStats:
    """The handful of numbers BM25 needs about the corpus as a whole."""
    totals = vocab.where(F.col("token").isNull()).first()
    if totals is None:
        return CorpusStats(0, 0.0, 0.0, 0)
    n_docs, n_words = totals["df"], totals["n_words"]
    # Words of equal frequency weigh the same, so the mean runs over frequencies; whole units add up in any order.
    levels = vocab.where(F.col("token").isNotNull()).groupBy("df").agg(F.count("*").alias("n"))
    units = F.round(F.col("n") * _raw_weight(F.col("df"), n_docs) * 1e10).cast("decimal(38,0)")
    row = levels.agg(F.sum(units).alias("w"), F.sum("n").alias("n")).first()
    n_terms = row["n"] or 0
    return CorpusStats(n_docs, n_words / n_docs, float(row["w"]) / 1e10 / n_terms if n_terms else 0.0, n_terms)


def term_weights(vocab: DataFrame, stats: CorpusStats) -> DataFrame:
    weight = _raw_weight(F.col("df"), stats.n_docs)
    return vocab.where(F.col("token").isNotNull()).select(
        "token", "df", F.when(weight < 0, F.lit(FLOOR * stats.mean_weight)).otherwise(weight).alias("idf")
    )


def bm25_stats(vocab: DataFrame) -> DataFrame:
    """Corpus statistics as one row."""
    s = corpus_stats(vocab)
    return vocab.sparkSession.createDataFrame(
        [(s.n_docs, s.n_terms, s.avg_words, s.mean_weight)],
        "n_docs long, n_terms long, avg_words double, mean_weight double",
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``(qid, token, qtf)``; a repeated word counts repeatedly."""
    words = explode_once(queries.select("qid", tx.tokenise(F.col("text")).alias("tokens")), "tokens", "token", "qid")
    return words.groupBy("qid", "token").agg(F.count("*").alias("qtf"))


def small(rows: DataFrame) -> DataFrame:
    """Broadcast a side whose size is counted and within bounds; a larger one is joined by shuffle."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else rows


def only_best(scored: DataFrame, by: str, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighted_queries(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """``qid, token, qtf, idf`` of the corpus's words; a query without any has one row without a word."""
    known = query_terms(queries).join(weights.select("token", "idf"), "token")
    return queries.select("qid").distinct().join(known, "qid", "left")


def query_groups(weighted: DataFrame) -> list[DataFrame]:
    """Rows of :func:`weighted_queries` in groups of queries that are small enough to be sent to all tasks."""
    n = weighted.count()
    many = 1 if n <= MAX_BROADCAST_ROWS else -(-2 * n // MAX_BROADCAST_ROWS)
    return [weighted if many == 1 else weighted.where(F.pmod(F.xxhash64("qid"), F.lit(many)) == i) for i in range(many if n else 0)]


def sent_queries(weighted: DataFrame) -> tuple[Broadcast, pa.DataType]:
    """One group's queries on every task, ``{qid: [(token, idf, qtf)]}``, and the type of their key."""
    rows = weighted.select("qid", "token", "idf", "qtf").toArrow()
    queries: dict = {}
    for q, *word in zip(*(rows.column(c).to_pylist() for c in ("qid", "token", "idf", "qtf"))):
        queries.setdefault(q, []).append(tuple(word))
    return weighted.sparkSession.sparkContext.broadcast(queries), rows.schema.field("qid").type


def _scored(words: DataFrame, weighted: DataFrame, avg: float, k: int, whole: bool) -> DataFrame:
    """``qid, id, units`` of the best ``k`` of every run of documents; ``whole`` with zeros and negative scores.

    Words are counted and scored by the same task, piece by piece; of a run only the queries' words are held.
    """
    shared, kind = sent_queries(weighted)
    schema = T.StructType([weighted.schema["qid"], words.schema["id"], T.StructField("units", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sorted({w[0] for words in shared.value.values() for w in words if w[0] is not None}), pa.string())

        def close() -> pa.RecordBatch:
            ids, shard = held.shard(avg)
            qids, place, units = shard.answers(shared.value, k, whole)
            return pa.RecordBatch.from_arrays([pa.array(qids, kind), ids.take(pa.array(place)), pa.array(units)], names=["qid", "id", "units"])

        held, size = Run(wanted), 0
        for batch in counted_batches(batches):
            held.add(batch)
            size += batch.nbytes
            if size >= RUN_BYTES:
                yield close()
                held, size = Run(wanted), 0
        if held.docs:
            yield close()

    return words.mapInArrow(run, schema)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """``(qid, rank, id, score)``: the ``k`` best documents of every query, zero scores included.

    One pass counts documents per word; a second scores whole documents where they are, with the query words'
    weights on every task, and hands on the best ``k`` of every run of documents.  Queries with fewer than ``k`` positive
    scores go through once more and take the first documents at zero as well, then those below.
    """
    vocab = materialise(vocabulary(docs), "vocabulary")
    stats = corpus_stats(vocab)
    if stats.n_terms == 0:
        return docs.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank int, id {docs.schema['id'].dataType.simpleString()}, score double")
    asked = materialise(weighted_queries(queries, term_weights(vocab, stats)), "query-weights")
    words = words_of(docs)
    best: DataFrame | None = None
    for part in query_groups(asked):
        found = materialise(_scored(words, part, stats.avg_words, k, False), "scores")
        enough = found.groupBy("qid").count().where(F.col("count") >= k)
        short = materialise(part.join(enough, "qid", "left_anti"), "short-queries")
        if not short.isEmpty():
            rest = _scored(words, short, stats.avg_words, k, True)
            found = found.join(short.select("qid").distinct(), "qid", "left_anti").unionByName(rest)
        best = found if best is None else best.unionByName(found)
    return only_best(best, "units", k).select("qid", "rank", "id", (F.col("units") / UNIT).alias("score"))


# ---------------------------------------------------------------------------------------------
# Vectors

# A query matrix of about this many numbers is sent to every task; beyond it queries go in groups.
MAX_SHARED_NUMBERS = 4_000_000
BLOCK_ROWS = 2048
# Scores that a task holds at once, and digits of a score: products of other shapes differ beyond them.
BLOCK_SCORES, SCORE_DIGITS = 4_000_000, 12


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype="float64") for v in values])


def _best(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, matrix: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of these vectors for every query; ties go to the lower id."""
    norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :]
    scores = np.round((vectors @ matrix.T) / np.maximum(norms, NORM_FLOOR), SCORE_DIGITS)
    by_id = np.argsort(ids, kind="stable")
    ids, scores = ids[by_id], scores[by_id]
    best = np.argsort(-scores, axis=0, kind="stable")[:k]
    columns = np.broadcast_to(np.arange(len(qids)), best.shape)
    return pd.DataFrame({"qid": qids[columns.ravel()], "id": ids[best.ravel()], "score": scores[best, columns].ravel()})


def _keep_best(scored: pd.DataFrame, k: int) -> pd.DataFrame:
    return scored.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid").head(k)


def _shared_scores(vectors: DataFrame, rows: list, schema: str, k: int) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(
        (np.array([r["qid"] for r in rows]), np.array([r["embedding"] for r in rows], dtype="float64"))
    )

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, matrix = shared.value
        best = None
        for pdf in frames:
            step = max(1, min(BLOCK_ROWS, BLOCK_SCORES // max(1, len(qids))))
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                new = _best(part["id"].to_numpy(), _matrix(part["embedding"]), qids, matrix, k)
                best = new if best is None else _keep_best(pd.concat([best, new]), k)
        if best is not None:
            yield best

    return vectors.mapInPandas(score, schema)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, max_shared: int = MAX_SHARED_NUMBERS) -> DataFrame:
    """``(qid, rank, id, score)`` by cosine of ``vectors(id, embedding)`` and ``queries(qid, embedding)``.

    Every task keeps its own best ``k`` per query, so the shuffle carries those only.
    """
    vectors, queries = vectors.select("id", "embedding"), queries.select("qid", "embedding")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    first = queries.select(F.size("embedding").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema.replace(", id", ", rank int, id", 1))
    room = max(1, max_shared // max(first["n"], 1))
    rows = queries.limit(room + 1).collect()  # at most max_shared numbers, and one row more to notice excess
    if len(rows) <= room:
        scored = _shared_scores(vectors, rows, schema, k)
    else:
        # Groups of queries, each sent to all tasks: vectors are read once a group and never move.
        groups = -(-2 * queries.count() // room)
        of = F.pmod(F.xxhash64("qid"), F.lit(groups))
        parts = (queries.where(of == i).collect() for i in range(groups))
        scored = functools.reduce(DataFrame.unionByName, [_shared_scores(vectors, part, schema, k) for part in parts if part])
    return only_best(scored, "score", k).select("qid", "rank", "id", "score")


# ---------------------------------------------------------------------------------------------
# Cached embeddings

# A text with more copies than one in this many rows is joined map-side.
HOT_SHARE = 1000


# Missing keys that are sent to every task, to leave known texts where they are.
MAX_SHARED_KEYS = 500_000
# Parts of a stored cache before they are written as one.
MAX_CACHE_PARTS = 50


_CACHE = "content_key string, embedding array<float>"


def cache_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored cache, one row per key; a missing one counts as empty.  Any other failure to read it is raised.

    A cache is the parts that its last version names (:mod:`docwarden.sources.snapshots`), or a plain table.
    """
    version, content = snapshots.latest(spark, path)
    parts = [f"{path}/{p}" for p in content["parts"]] if version else [path]
    try:
        return spark.read.schema(_CACHE).parquet(*parts).dropDuplicates(["content_key"])
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND" or version:
            raise
        return spark.createDataFrame([], _CACHE)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``(content_key, text)`` of every distinct text the cache lacks.

    Keys are folded and looked up first.  Copies of a text are folded before they move, so one that fills a third
    of the rows costs one row per task; up to ``MAX_SHARED_KEYS`` missing keys, no other texts move at all.
    """
    keyed = texts.select(tx.content_hash(F.col("text")).alias("content_key"), "text")
    missing = keyed.select("content_key").distinct().join(cache.select("content_key"), "content_key", "left_anti")
    missing = materialise(missing, "missing-keys")
    if missing.count() <= MAX_SHARED_KEYS:
        keyed = keyed.join(F.broadcast(missing), "content_key", "left_semi")
    new = keyed.groupBy("content_key").agg(F.first("text").alias("text"))
    return new.join(missing, "content_key", "left_semi")


def embed_missing(texts: DataFrame, cache: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    """Cache rows for all missing texts; ``provider`` turns a text column into vectors."""
    vectors = provider(F.col("text")).cast("array<float>")
    return cache_misses(texts, cache).select("content_key", vectors.alias("embedding"))


def extend_cache(texts: DataFrame, cache: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    """The cache with the embeddings of all missing texts."""
    return cache.unionByName(embed_missing(texts, cache, provider))


def update_cache(texts: DataFrame, path: str, provider: Callable[[Column], Column]) -> DataFrame:
    """Add the embeddings of all missing texts to the stored cache at ``path`` as a new version, and open it.

    The version before stays readable while new rows are written, and is the last one if the job dies.  If another
    writer publishes first, the rows that it has added too are dropped and the rest is published after it.
    A plain table at ``path`` becomes the first part.  Beyond :data:`MAX_CACHE_PARTS` parts all are written as one.
    """
    spark = texts.sparkSession
    written = f"parts/{uuid.uuid4().hex}"

    def add(version: int, content: dict) -> dict | None:
        cache = cache_table(spark, path)
        parts = content.get("parts", [])
        if not version and not cache.isEmpty():  # a plain table: its rows are taken over
            parts = [f"parts/{uuid.uuid4().hex}"]
            cache.write.parquet(f"{path}/{parts[0]}")
        new = spark.read.schema(_CACHE).parquet(f"{path}/{written}") if tried else embed_missing(texts, cache, provider)
        if tried:
            new = new.join(cache.select("content_key"), "content_key", "left_anti")
        part = f"parts/{uuid.uuid4().hex}" if tried else written
        tried.append(part)
        if len(parts) >= MAX_CACHE_PARTS:
            new, parts = cache.unionByName(new), []
        new.write.parquet(f"{path}/{part}")
        return {"parts": [*parts, part]}

    tried: list[str] = []
    snapshots.change(spark, path, add)
    return cache_table(spark, path)


def embed_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``texts`` with ``content_key`` and ``embedding`` from the cache.

    Texts may repeat without bound.  Keys that hold a large share of the rows are few by definition
    (fewer than ``HOT_SHARE``), so their embeddings are joined by broadcast; the rest is joined by key.
    """
    keyed = texts.withColumn("content_key", tx.content_hash(F.col("text")))
    counts = materialise(keyed.groupBy("content_key").agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1000, total // HOT_SHARE)
    hot_keys = F.broadcast(counts.where(F.col("n") > least).select("content_key"))  # fewer than HOT_SHARE rows
    hot = F.broadcast(hot_keys.join(cache, "content_key", "left").select("content_key", "embedding"))
    of_hot = keyed.join(hot, "content_key")
    of_cold = keyed.join(hot_keys, "content_key", "left_anti").join(cache, "content_key", "left")
    return of_hot.unionByName(of_cold)


@dataclass(frozen=True)
class DocumentIndex:
    """Search over ``docs(id, content)``: by vectors when there is a provider or a vector table, else by words.

    With a vector table and no provider, queries bring their own ``embedding``; those without one, and all queries
    if the provider fails to give an expression, are answered by words.
    """

    docs: DataFrame
    provider: Callable[[Column], Column] | None = None
    vectors: DataFrame | None = None
    words: bool = True

    @property
    def mode(self) -> str:
        if self.provider is not None or self.vectors is not None:
            return "dense"
        return "bm25" if self.words else "none"

    def search(self, queries: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
        """Documents with ``qid``, ``rank`` and ``score``, all their columns kept."""
        if self.mode == "none":
            return self.docs.limit(0).select(
                "id", F.lit(0).alias("qid"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"), *[c for c in self.docs.columns if c != "id"]
            )
        dense = self._dense(queries) if self.mode == "dense" else None
        if dense is not None:
            found = cosine_topk(*dense, top_k)
        else:
            found = bm25_topk(self.docs, queries, top_k)
        return found.join(self.docs, "id")

    def _dense(self, queries: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Vectors of documents and queries, or None where they cannot be had."""
        try:
            vectors = self.vectors
            if vectors is None:
                vectors = self.docs.select("id", self.provider(F.col("content")).alias("embedding"))
            if "embedding" in queries.columns:
                return vectors, queries.select("qid", "embedding")
            return vectors, queries.select("qid", self.provider(F.col("text")).alias("embedding"))
        except Exception:  # noqa: BLE001 - whatever the provider raises, words still answer
            if not self.words:
                raise
            logger.warning("No vectors for this search; it goes by words", exc_info=True)
            return None
