from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm.shards import block_sizes, hypergeometric, matrix_row, shuffle_into_shards


def test_exact_sizes_and_all_rows(spark):
    df = spark.range(0, 1003, 1, 7).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("old").alias("shard"))
    out = shuffle_into_shards(df, 40, seed=3, block_rows=8)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1003))
    by = Counter(r["shard"] for r in rows)
    assert set(by) == set(range(40)) and max(by.values()) - min(by.values()) == 1
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(df, 40, seed=3, block_rows=8).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    other = {r["doc_id"]: r["shard"] for r in shuffle_into_shards(df, 40, seed=4, block_rows=8).collect()}
    assert sum(other[r["doc_id"]] == r["shard"] for r in rows) < 200


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shuffle_into_shards(empty, 3).count() == 0
    few = spark.createDataFrame([(None, None), (None, None), (1, "")], "doc_id long, text string")
    out = shuffle_into_shards(few, 5).collect()
    assert len(out) == 3 and all(r["slot"] == 0 for r in out) and len({r["shard"] for r in out}) == 3
    with pytest.raises(ValueError):
        shuffle_into_shards(few, 0)


def test_matrix_adds_up():
    counts = np.array([5, 0, 17, 3, 40, 1])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sizes, owner = block_sizes(int(bounds[-1]), 4, 5)
    total = np.zeros(len(sizes), dtype=int)
    for c in range(len(counts)):
        sends, before = matrix_row(c, bounds, sizes, 9)
        assert sends.sum() == counts[c] and (before == total).all()
        total += sends
    assert (total == sizes).all()


def test_law_of_the_large_sampler(monkeypatch):
    """The ratio of uniforms agrees with the exact mean and variance."""
    rng = np.random.default_rng(1)
    good, bad, draws = 3_000_000_000, 1_000_000_000, 1000
    got = np.array([hypergeometric(rng, good, bad, draws) for _ in range(4000)])
    assert abs(got.mean() - 750) < 1 and abs(got.var() / 187.5 - 1) < 0.1
    assert hypergeometric(rng, 5, 0, 3) == 3


def test_uniform():
    """Each cell's rows are equally likely to go to each target."""
    bounds, sizes = np.array([0, 4, 6]), np.array([3, 3])
    sends = np.array([matrix_row(0, bounds, sizes, seed)[0] for seed in range(3000)])
    assert abs(sends[:, 0].mean() - 2) < 0.05
    share = [(sends[:, 0] == k).mean() for k in (1, 2, 3)]
    assert np.allclose(share, [3 / 15, 9 / 15, 3 / 15], atol=0.03)
