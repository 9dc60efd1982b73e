"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes ratios.

Features are the hashed character n-grams (two to six bytes of a padded, lower-cased word) of a text, valued
1 + log(occurrences).  A feature's ratio is the logarithm of how much more of it toxic texts have than others.
The features with the most significant ratios are kept, each value is scaled by its ratio, and a logistic
regression with an L2 penalty weighs them.

The classifier is fitted on a bounded sample of labelled rows (``max_rows``), drawn by a hash of the id from all
that may be used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.scratch import materialise

from .labelled import sample_labelled
from .text_bytes import U64, mix64, row_chunks, text_buffer, worker_cache

#: Buckets of hashed n-grams, features kept of them, and labelled rows that are learned from at most (in expectation).
BUCKETS = 1 << 22
FEATURES = 1024
MAX_ROWS = 10_000
SHORTEST, LONGEST = 2, 6
_PIECE = 1 << 18


def _byte_map() -> np.ndarray:
    """Bytes to lower-case bytes; ASCII that is neither letter nor digit becomes a blank."""
    out = np.arange(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() else 32
    return out


def gram_buckets(data: np.ndarray, row: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs as ``row * BUCKETS + bucket``, sorted, and their counts; row: the row of each byte.

    ``wanted``, one flag per bucket, leaves out all others.

    N-grams are of UTF-8 bytes, lie in one word and its two blanks, and never cross rows.
    """
    table = worker_cache("toxicity_bytes", _byte_map)
    found = []
    for at in range(0, len(data), _PIECE):
        lap = slice(at, at + _PIECE + LONGEST)  # n-grams that start in this piece end in the lap
        byte, own = table[data[lap]], row[lap]
        edge = np.flatnonzero(np.diff(own)) + 1
        border = byte == 32
        x = byte.astype(U64) + U64(1)
        h = mix64(x)
        inner = np.zeros(len(byte), dtype=bool)  # a blank inside the n-gram, or a border of rows
        cut = np.zeros(len(byte), dtype=bool)
        cut[edge] = True
        parts = []
        with np.errstate(over="ignore"):
            for n in range(2, LONGEST + 1):
                m = len(byte) - n + 1
                if m <= 0:
                    break
                h = (h[:m] ^ x[n - 1 :]) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(29)
                inner = inner[:m] | cut[n - 1 :]
                if n > 2:
                    inner |= border[n - 2 : n - 2 + m]
                if n >= SHORTEST:
                    ok = np.flatnonzero(~inner[:_PIECE])
                    bucket = (mix64(h[ok] + U64(n)) & U64(BUCKETS - 1)).astype(np.int64)
                    if wanted is not None:
                        hit = np.flatnonzero(wanted[bucket])
                        ok, bucket = ok[hit], bucket[hit]
                    parts.append(own[ok].astype(np.int64) * BUCKETS + bucket)
        if parts:
            found.append(np.unique(np.concatenate(parts), return_counts=True))
    if len(found) == 1:
        return found[0]
    pairs, where = np.unique(np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)]), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate([np.zeros(0), *(f[1] for f in found)]), len(pairs))


def batch_features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, bucket, value`` of all distinct features of a column of texts, with a blank before and after each."""
    column = pa.compute.fill_null(column, "")
    column = pa.compute.binary_join_element_wise(" ", column, " ", "")
    data, bounds = text_buffer(column)
    both, counts = gram_buckets(data, np.repeat(np.arange(len(column), dtype=np.int32), np.diff(bounds)), wanted)
    return both // BUCKETS, both % BUCKETS, 1 + np.log(counts)


class ToxicityModel(NamedTuple):
    bucket: np.ndarray  # sorted
    weight: np.ndarray
    bias: float


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on the labelled rows of ``docs``; texts are compared by n-grams only.

    Counts of n-grams are made by Spark over the whole sample; only the chosen features of the sample's rows,
    whose number is bounded, come to the driver for the regression.  Without any toxic or any other row the
    model is a constant.  Null texts count as empty ones.
    """
    rows = materialise(sample_labelled(docs, labels, key, text, label, max_rows), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        for batch in row_chunks(batches, "_text", _PIECE):
            y = np.asarray(batch.column("_y"))
            row, bucket, value = batch_features(batch.column("_text"))
            for sums, chosen in ((toxic, y[row] > 0), (other, y[row] <= 0)):
                sums += np.bincount(bucket[chosen], value[chosen], BUCKETS).astype(np.float32)
        at = np.flatnonzero(toxic + other)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(toxic[part].astype(float)), pa.array(other[part].astype(float))], names=["bucket", "p", "q"])

    sums = rows.groupBy(F.col("_y") > 0).count().collect()
    totals = {bool(r[0]): r["count"] for r in sums}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    base = float(np.log((n_toxic + 0.5) / (n_other + 0.5)))
    if not n_toxic or not n_other:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), base)
    counts = rows.repartition(8).mapInArrow(count, "bucket long, p double, q double").groupBy("bucket")
    # Sums of whole units do not depend on the order of rows.
    unit = lambda c: (F.sum(F.round(F.col(c) * 1000).cast("long")) / 1000).alias(c)
    counts = counts.agg(unit("p"), unit("q")).where("p + q >= 3")
    p, q = (F.col("p") + 0.5) / (n_toxic + 1.0), (F.col("q") + 0.5) / (n_other + 1.0)
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    ratio = counts.select("bucket", (F.log(p) - F.log(q)).alias("r"), (F.abs(F.log(p) - F.log(q)) / spread).alias("z"))
    chosen = ratio.orderBy(F.desc("z"), "bucket").limit(features).collect()
    bucket = np.array([c["bucket"] for c in chosen], dtype=np.int64)
    r = np.array([c["r"] for c in chosen])
    order = np.argsort(bucket)
    bucket, r = bucket[order], r[order]

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[bucket] = True
        for batch in row_chunks(batches, "_text", _PIECE):
            row, found, value = batch_features(batch.column("_text"), wanted)
            at = np.minimum(np.searchsorted(bucket, found), len(bucket) - 1)
            hit = bucket[at] == found
            first = np.searchsorted(row[hit], np.arange(batch.num_rows + 1))
            bounds = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (at[hit].astype(np.int32), value[hit])]
            yield pa.RecordBatch.from_arrays([*lists, batch.column("_y")], names=["x", "v", "_y"])

    table = rows.repartition(8).mapInArrow(design, "x array<int>, v array<double>, _y int").toArrow().combine_chunks()
    x, v = table.column("x").combine_chunks(), table.column("v").combine_chunks()
    weight, bias = _logistic(np.asarray(x.flatten()), np.asarray(v.flatten()), np.asarray(x.value_lengths()), np.asarray(table.column("_y")) > 0, r, base)
    return ToxicityModel(bucket, weight * r, bias)


def _logistic(at: np.ndarray, value: np.ndarray, lengths: np.ndarray, y: np.ndarray, r: np.ndarray, bias: float, penalty: float = 3e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by gradient steps with per-weight rates (Adam)."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    value = value * r[at]
    w = np.zeros(len(r) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        z = np.bincount(row, w[at] * value, len(lengths)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(at, err[row] * value, len(r)) / len(y) + penalty * w[:-1], err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that ``text`` is toxic; higher means likelier.

    Null and empty texts get the score of a text without features.  Equal texts get equal scores.  Rows are
    kept one to one with all other columns; a column that has the new one's name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kept = docs.drop(score)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{score}` double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(*shared.value)
        dense, wanted = np.zeros(BUCKETS, np.float64), np.zeros(BUCKETS, dtype=bool)
        dense[m.bucket], wanted[m.bucket] = m.weight, True
        for batch in row_chunks(batches, text):
            row, bucket, value = batch_features(batch.column(text), wanted)
            z = np.bincount(row, dense[bucket] * value, batch.num_rows) + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, score])

    return kept.mapInArrow(run, ", ".join(fields))
