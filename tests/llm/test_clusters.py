import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm.clusters import ADDED, Centres, cluster_vectors, most, whole


def brute(rows, k, rounds, dim, scale=64):
    kept = [(i, key, [math.floor(scale * float(x)) for x in v]) for i, (key, v) in enumerate(rows) if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[1] is None, hashlib.sha256(f"1:{r[1]}".encode()).hexdigest(), [float(x) for x in rows[r[0]][1]]))
    centres = [r[2] for r in named[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(q)[1] for _, _, q in kept]
        for c in range(len(centres)):
            mine = [q for (_, _, q), o in zip(kept, of) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    last = {i: nearest(q) for i, _, q in kept}
    out = {}
    for i, (d, c) in last.items():
        inertia = sum(x for x, o in last.values() if o == c)
        out[i] = (c, d, inertia, sum(x for x, _ in last.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
    return out


def rows_of(n, dim, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(5, dim))
    rows = [(i, (centre[i % 5] + r.normal(size=dim) * 0.3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, rows[0][1]), (0, rows[1][1]), (0, rows[1][1]), (None, rows[2][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * (dim - 1)), (n + 4, [1.0] * (dim + 1))]
    rows += [(n + 5, [math.nan] + [0.0] * (dim - 1)), (n + 6, [math.inf] + [0.0] * (dim - 1)), (n + 7, [None] + [0.0] * (dim - 1)), (n + 8, [0.0] * dim), (n + 9, [-0.0] * dim)]
    return rows


def clustered(spark, rows, schema="vec_id long, embedding array<float>", **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row int, {schema}").repartition(3)
    return {r["row"]: tuple(r[c] for c in ADDED) for r in cluster_vectors(df, **options).collect()}


@pytest.mark.parametrize("k,rounds", [(4, 0), (4, 2), (7, 3), (500, 1)])
def test_equals_plain_rounds(spark, k, rounds):
    rows = rows_of(60, 6, k)
    got = clustered(spark, rows, k=k, rounds=rounds, dim=6)
    want = brute(rows, k, rounds, 6)
    assert got == {i: want.get(i, (None,) * 5) for i in range(len(rows))}


def test_string_keys_doubles_and_clashing_columns(spark):
    rows = [(f"k{i}", v) for i, v in rows_of(40, 4, 1)]
    df = spark.createDataFrame([(i, *r, 1, 2, 3, 4, "x", 5) for i, r in enumerate(rows)], "row int, vec_id string, embedding array<double>, Cluster int, v int, h int, part int, distance string, c int")
    out = cluster_vectors(df, k=3, rounds=2, dim=4)
    assert [c for c in out.columns if c not in ADDED] == ["row", "vec_id", "embedding", "v", "h", "part", "c"]
    want = brute(rows, 3, 2, 4)
    assert {r["row"]: tuple(r[c] for c in ADDED) for r in out.collect()} == {i: want.get(i, (None,) * 5) for i in range(len(rows))}


def test_no_usable_vectors(spark):
    assert clustered(spark, [(1, None), (2, [1.0])]) == {0: (None,) * 5, 1: (None,) * 5}
    assert clustered(spark, []) == {}
    empty = cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert dict(empty.dtypes)["distance"] == "bigint"


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(Exception, match="64 bits"):
        clustered(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])


@pytest.mark.parametrize("size", [1, 40, most(5)])
def test_search_is_exact_with_ties(size):
    r = np.random.default_rng(3)
    for k in (1, 2, 17, 100):
        centres = Centres(r.integers(-size, size + 1, (k, 5)))
        x = r.integers(-size, size + 1, (300, 5))
        away = ((x[:, None] - centres.rows[None]) ** 2).sum(axis=2)
        who, best = centres.nearest(x)
        assert (who == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


def test_search_skips_centroids():
    r = np.random.default_rng(4)
    shape = r.normal(size=(64, 1)) * 100
    centres = Centres(np.round(shape + r.normal(size=(64, 8)) * 10).astype(np.int64))
    x = centres.rows[r.integers(0, 64, 1000)] + r.integers(-3, 4, (1000, 8))
    centres.nearest(x)
    assert centres.compared < 0.25 * 1000 * 64


def test_floor():
    assert whole(np.array([[-0.001, 0.999, 1.0, -1.0]])).tolist() == [[-1, 63, 64, -64]]


def test_query_reads_whole_table(spark):
    from docwarden.llm.queries import QUERIES

    out = QUERIES["op11_centroids"](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert out.agg(F.countDistinct("cluster")).first()[0] == 16
