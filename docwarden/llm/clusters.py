"""Clusters of vectors around centroids, in whole numbers, with an equal-average equal-variance search.

Every component is scaled and floored to a whole number, so that distances, sums and centroids are exact and
do not depend on the order of rows.  The centroids are sorted by the mean of their components.  For a
vector x and a centroid c of d components with means m and deviations v (the root of the summed squares around
the mean)

    |x - c|^2  >=  d (m_x - m_c)^2 + (v_x - v_c)^2,

so a vector looks at the centroids outward from its own mean, stops on a side once the first term alone exceeds
the best distance, skips a centroid if both terms do, and computes the exact distance of the others.

Each round is one pass over the table: every task adds up its vectors by centroid, and the sums of all tasks meet
in one aggregate of ``k * (d + 1)`` rows, which is all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector_rows import few_rows, vectors, with_fields

SCALE, DIM, CLUSTERS, ROUNDS = 64, 64, 16, 3
ADDED = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def most(dim: int) -> int:
    """The largest size of a whole component for which no squared distance passes 64 bits."""
    return int((2**62 // dim) ** 0.5) // 2


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    scaled = np.floor(values * scale)
    if len(scaled) and max(scaled.max(), -scaled.min()) > most(values.shape[1]):
        raise OverflowError(f"a component is beyond {most(values.shape[1])} after scaling; squared distances would pass 64 bits")
    return scaled.astype(np.int64)


class Centres:
    """Centroids by their mean; ``nearest`` gives the number and exact squared distance of the nearest one."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        k, self.dim = rows.shape
        mean = rows.sum(axis=1) / self.dim
        self.number = np.argsort(mean, kind="stable")
        self.sorted, self.mean = rows[self.number], mean[self.number]
        self.deviation = self._deviation(self.sorted, self.mean)
        self.compared = 0

    @staticmethod
    def _deviation(rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.sqrt(((rows - mean[:, None]) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = x.sum(axis=1) / self.dim
        deviation = self._deviation(x, mean)
        best = np.full(len(x), np.iinfo(np.int64).max)
        who = np.full(len(x), len(self.rows))
        right = np.searchsorted(self.mean, mean)
        sides = [[np.arange(len(x)), right, 1], [np.arange(len(x)), right - 1, -1]]
        while any(len(s[0]) for s in sides):
            for side in sides:
                row, at, step = side
                inside = (at >= 0) & (at < len(self.mean))
                row, at = row[inside], at[inside]
                by_mean = self.dim * (mean[row] - self.mean[at]) ** 2
                # A little is taken off the bounds for the rounding of floats; equal distances are always looked at.
                near = by_mean * (1 - 1e-9) - 1 <= best[row]
                row, at, by_mean = row[near], at[near], by_mean[near]
                bound = by_mean + (deviation[row] - self.deviation[at]) ** 2
                open_ = bound * (1 - 1e-9) - 1 <= best[row]
                r, c = row[open_], at[open_]
                self.compared += len(r)
                away = ((x[r] - self.sorted[c]) ** 2).sum(axis=1)
                number = self.number[c]
                better = (away < best[r]) | ((away == best[r]) & (number < who[r]))
                best[r[better]], who[r[better]] = away[better], number[better]
                side[0], side[1] = row, at + step
        return who, best


def usable(vector: str, dim: int) -> Column:
    """Rows whose vector has ``dim`` components, none null or not finite."""
    infinite = F.lit(float("inf"))
    # The comparison is done in one lambda, so no row of another length is looked into.
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < infinite, F.lit(False))), F.lit(False))


def first_centres(df: DataFrame, key: str, vector: str, k: int, dim: int, scale: int = SCALE) -> np.ndarray:
    """The usable vectors with the ``k`` least hashes of their key; equal keys go by their vectors, rows without key come last."""
    named = F.sha2(F.concat(F.lit("1:"), F.col(f"`{key}`").cast("string")).cast("binary"), 256)
    rows = df.where(usable(f"`{vector}`", dim)).select(named.alias("h"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    found = rows.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return whole(np.array([r["v"] for r in found], dtype=np.float64).reshape(-1, dim), scale)


def _sums(df: DataFrame, vector: str, centres: np.ndarray, scale: int) -> dict[int, dict[int, int]]:
    """Per centroid: the sum of each component, the number of vectors (-1) and their summed distance (-2)."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centres(centres)
        total = np.zeros((len(centres), dim), dtype=np.int64)
        n = np.zeros(len(centres), dtype=np.int64)
        away = [0] * len(centres)
        for batch in few_rows(batches):
            x = whole(vectors(batch.column(0), dim)[1], scale)
            if not len(x):
                continue
            who, distance = search.nearest(x)
            for c in np.unique(who):
                mine = who == c
                total[c] += x[mine].sum(axis=0)
                n[c] += mine.sum()
                away[c] += sum(distance[mine].tolist())
        for c in np.flatnonzero(n).tolist():
            # Summed distances may pass 64 bits on their own, so they go in two parts.
            values = [*total[c].tolist(), int(n[c]), away[c] & 0xFFFFFFFF, away[c] >> 32]
            parts = [*range(dim), -1, -2, -3]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array(values, pa.int64())], names=["cluster", "part", "total"])

    sums = df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "cluster int, part int, total long")
    rows = sums.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["cluster"], {})[r["part"]] = int(r["total"])
    for parts in out.values():
        parts[-2] += parts.pop(-3) << 32
    return out


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE
) -> DataFrame:
    """Add ``cluster, distance, cluster_inertia, inertia, centroid_sha256`` to every row.

    The vectors with the ``k`` least hashes of their key start as centroids; ``rounds`` times every vector goes to the
    nearest one (ties: the smaller number), and each centroid with vectors becomes the floor of their mean.  Then
    all are assigned once more.  The digest is of the final centroid's whole numbers joined by commas.

    Vectors that are null, of another length, or hold null or non-finite components take no part and get nulls;
    without usable vectors all rows do.  With fewer than ``k`` of them there are fewer centroids.  Equal keys
    and repeated rows count each; keys may be of any type and null.  Other columns are kept; columns with the names of
    new ones are replaced.  Components beyond :func:`most` after scaling stop the job, as distances would pass 64 bits.
    ``k * dim`` numbers go to all tasks; nothing else does.
    """
    centres = first_centres(df, key, vector, k, dim, scale)
    kept = df.drop(*(c for c in ADDED if c not in (key, vector)))
    types = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    if not len(centres):
        return kept.withColumns({n: F.lit(None).cast(t) for n, t in zip(ADDED, types)})
    for _ in range(rounds):
        centres = centres.copy()
        for c, parts in _sums(df, vector, centres, scale).items():
            centres[c] = [parts[i] // parts[-1] for i in range(dim)]
    by_cluster = {c: parts[-2] for c, parts in _sums(df, vector, centres, scale).items()}
    inertia = [by_cluster.get(c, 0) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centres.tolist()]
    column = kept.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centres(centres)
        whole_sum = sum(inertia)
        for batch in few_rows(batches):
            row, values = vectors(batch.column(column), dim)
            who, away = search.nearest(whole(values, scale)) if len(row) else (row, row)
            place = np.full(batch.num_rows, -1)
            place[row] = np.arange(len(row))
            at = pa.array(place, mask=place < 0)
            who = pa.array(who.astype(np.int32)).take(at)
            new = [who, pa.array(away).take(at), pa.array(inertia, pa.int64()).take(who), pa.array([whole_sum] * len(inertia), pa.int64()).take(who), pa.array(digest).take(who)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *ADDED])

    return kept.mapInArrow(run, with_fields(kept.schema, list(zip(ADDED, types))))
