"""Exact nearest vectors by cosine from a stored table in clusters, most of which a search need not look at.

Some vectors, drawn by the hash of their ids, are pivots; every vector lies in the cluster of the pivot with the least
angle to it, in the order of that angle.  Angles between directions obey the triangle inequality: a vector at the angle t
of its pivot is at least |p - t| away from a query at the angle p of that pivot.  So a cluster of radius r holds nothing
better than cos(p - r), and of a cluster only a ring can hold results.

A search goes in rounds.  Each query takes the clusters with the best bounds first, a few more every round, and stops when
no other cluster's bound reaches its k-th best score so far.  Vectors stay where they are stored; queries, in groups of
bounded size, go to the tasks that read the clusters they take.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarden.operators.search import DEFAULT_TOP_K, _best, only_best
from docwarden.scratch import materialise
from docwarden.sources import snapshots

#: Pivots at most; numbers of queries (their components, and their angles to all pivots) that are sent at once.
MAX_PIVOTS, MAX_NUMBERS = 4096, 4_000_000
#: Vectors and queries shorter than this are compared with everything: their cosines do not depend on angles alone.
SHORT, SHORT_QUERY = 1e-3, 1e-6
#: Taken off bounds for the rounding of angles and scores.
MARGIN = 1e-6
#: The cluster of short vectors.
REST = -1


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(pa.compute.cast(column.flatten(), pa.float64()))
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to unit pivots."""
    norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip((x / norm) @ pivots.T, -1.0, 1.0))


def build_vectors(vectors: DataFrame, path: str, pivots: int | None = None) -> None:
    """Store ``vectors(id, embedding)``, all of one length, in clusters at ``path``, where there is nothing yet."""
    spark = vectors.sparkSession
    rows = vectors.select("id", "embedding")
    n = rows.count()
    many = max(1, min(MAX_PIVOTS, pivots or math.isqrt(n)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(many).select("embedding").collect()
    x = np.array([r["embedding"] for r in drawn], dtype=np.float64)
    long = np.linalg.norm(x, axis=1) >= SHORT if len(x) else np.zeros(0, bool)
    units = x[long] / np.linalg.norm(x[long], axis=1, keepdims=True) if long.any() else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                m = _matrix(part.column("embedding"))
                cluster, angle = np.full(len(m), REST, dtype=np.int32), np.zeros(len(m))
                if len(shared.value):
                    to = _angles(m, shared.value)
                    near = to.argmin(axis=1)
                    far = np.linalg.norm(m, axis=1) >= SHORT
                    cluster[far], angle[far] = near[far], to[np.arange(len(m)), near][far]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cluster), pa.array(angle)], names=["id", "embedding", "cluster", "angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = rows.mapInArrow(run, schema).repartitionByRange("cluster", "angle").sortWithinPartitions("cluster", "angle")
    name = uuid.uuid4().hex
    placed.write.parquet(f"{path}/{name}")
    stored = spark.read.schema(schema).parquet(f"{path}/{name}")
    sizes = stored.groupBy("cluster").agg(F.max("angle").alias("radius")).collect()  # a row per pivot
    clusters = {str(r["cluster"]): r["radius"] for r in sizes}
    spark.createDataFrame([(u.tolist(),) for u in units], "unit array<double>").coalesce(1).write.parquet(f"{path}/{name}-pivots")
    id_type, kind = (rows.schema[c].dataType.simpleString() for c in ("id", "embedding"))
    snapshots.publish(spark, path, 0, {"rows": name, "n": n, "clusters": clusters, "id": id_type, "embedding": kind})


def _round(stored: DataFrame, taken: dict[int, np.ndarray], qids: np.ndarray, matrix: np.ndarray, to_pivots: np.ndarray, reach: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
    """The best ``k`` of these queries in the clusters that each takes, and a row without ``qid`` for what was compared."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast((taken, qids, matrix, to_pivots, reach))
    columns = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        taken, qids, matrix, to_pivots, reach = shared.value
        best, compared = None, 0
        for batch in batches:
            cluster, angle = np.asarray(batch.column("cluster")), np.asarray(batch.column("angle"))
            m = _matrix(batch.column("embedding"))
            for c in np.unique(cluster).tolist():
                inside = np.flatnonzero(cluster == c)
                asks = taken.get(c, ())
                if not len(asks):
                    continue
                if c == REST:
                    low, high = np.full(len(asks), -1.0), np.full(len(asks), 9.0)
                else:
                    low, high = to_pivots[asks, c] - reach[asks], to_pivots[asks, c] + reach[asks]
                # Queries of one cluster that want about the same ring are compared together.
                for some in np.array_split(np.argsort(low, kind="stable"), max(1, len(asks) // 64)):
                    rows = inside[(angle[inside] >= low[some].min()) & (angle[inside] <= high[some].max())]
                    q = asks[some]
                    for at in range(0, len(rows), 4096):
                        part = rows[at : at + 4096]
                        compared += len(part) * len(q)
                        ids = batch.column("id").take(pa.array(part)).to_pandas().to_numpy()
                        new = _best(ids, m[part], qids[q], matrix[q], k)
                        best = new if best is None else pd.concat([best, new]).sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid").head(k)
        if best is not None:
            best["compared"] = None
            yield pa.RecordBatch.from_pandas(best[columns], schema=arrow, preserve_index=False)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, arrow.field(c).type) for c in columns[:-1]), pa.array([compared], pa.int64())], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    wanted = stored.where(F.col("cluster").isin(sorted(taken)))
    return wanted.mapInArrow(run, schema)


def _search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> tuple[DataFrame | None, dict]:
    version, content = snapshots.latest(spark, path)
    if not version:
        raise FileNotFoundError(f"no vectors at {path}")
    stored = spark.read.schema(f"id {content['id']}, embedding {content['embedding']}, cluster int, angle double").parquet(f"{path}/{content['rows']}")
    units = np.array([r["unit"] for r in spark.read.schema("unit array<double>").parquet(f"{path}/{content['rows']}-pivots").collect()], dtype=np.float64)
    clusters = {int(c): r for c, r in content["clusters"].items()}
    real = np.array(sorted(c for c in clusters if c != REST), dtype=np.int64)
    radius = np.array([clusters[c] for c in real.tolist()])
    asked = queries.select("qid", "embedding")
    first = asked.select(F.size("embedding").alias("n")).first()
    if first is None or not content["n"]:
        return None, content
    schema = T.StructType([asked.schema["qid"], *T.StructType.fromDDL(f"id {content['id']}, score double, compared long")])
    room = max(1, MAX_NUMBERS // max(first["n"], len(real), 1))
    groups = -(-asked.count() // room)
    found: DataFrame | None = None
    for g in range(groups):
        part = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g)
        rows = part.toArrow()
        qids, matrix = rows.column("qid").to_pandas().to_numpy(), _matrix(rows.column("embedding").combine_chunks())
        if not len(qids):
            continue
        to_pivots = np.zeros((len(qids), 0)) if not len(units) else _angles(matrix, units)
        # The best score that a cluster can give; short queries take all.
        bound = np.cos(np.maximum(0, to_pivots[:, real] - radius)) + MARGIN if len(real) else np.zeros((len(qids), 0))
        bound[np.linalg.norm(matrix, axis=1) < SHORT_QUERY] = np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        sorted_bound = np.take_along_axis(bound, order, axis=1)
        threshold = np.full(len(qids), -np.inf)
        done, step = np.zeros(len(qids), dtype=np.int64), 1
        mine: DataFrame | None = None
        while True:
            last = np.minimum(len(real), done + step)
            taken: dict[int, list[int]] = {}
            for i in range(len(qids)):
                for j in range(int(done[i]), int(last[i])):
                    if sorted_bound[i, j] < threshold[i]:
                        last[i] = len(real)  # no other cluster can hold anything
                        break
                    taken.setdefault(int(real[order[i, j]]), []).append(i)
            if mine is None and REST in clusters:
                taken[REST] = list(range(len(qids)))
            if not taken and (done >= len(real)).all():
                break
            if taken:
                reach = np.where(np.isfinite(threshold), np.arccos(np.clip(threshold - MARGIN, -1, 1)) + MARGIN, 9.0)
                reach[np.linalg.norm(matrix, axis=1) < SHORT_QUERY] = 9.0
                one = materialise(_round(stored, {c: np.array(v) for c, v in taken.items()}, qids, matrix, to_pivots, reach, k, schema), "vector-round")
                mine = one if mine is None else mine.unionByName(one)
                kth = only_best(mine.where("qid IS NOT NULL"), "score", k).where(F.col("rank") == k).select("qid", "score")
                scores = dict(map(tuple, kth.collect()))  # a number per query of the group
                threshold = np.array([scores.get(q, -np.inf) for q in qids.tolist()])
            done, step = last, step * 4
        if mine is not None:
            found = mine if found is None else found.unionByName(mine)
    return found, content


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """``(qid, rank, id, score)``: the ``k`` nearest stored vectors of ``queries(qid, embedding)``, as ``cosine_topk`` gives."""
    found, content = _search(spark, path, queries, k)
    if found is None:
        return spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank int, id {content['id']}, score double")
    return only_best(found.where("qid IS NOT NULL"), "score", k).select("qid", "rank", "id", "score")


def search_share(spark: SparkSession, path: str, queries: DataFrame, k: int = DEFAULT_TOP_K) -> float:
    """The share of all pairs of a query and a vector that a search compares."""
    found, content = _search(spark, path, queries, k)
    compared = found.where("qid IS NULL").agg(F.sum("compared")).first()[0] if found is not None else 0
    return (compared or 0) / max(1, content["n"] * queries.count())
