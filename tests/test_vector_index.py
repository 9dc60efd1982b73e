import numpy as np
import pytest

from docwarden.operators import search as se
from docwarden.operators import vector_index as vi
from tests.test_search import rows, vectors


def grouped(seed, n=1500, groups=30, dim=12, spread=0.15):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, dim))
    v = centres[random.integers(0, groups, n)] + spread * random.normal(size=(n, dim))
    v[7] = v[3]
    v[20:23] = 0
    v[23] = 1e-7
    v[24] *= 1e-4
    return v, np.vstack([centres[:10] + 0.05 * random.normal(size=(min(10, groups), dim)), random.normal(size=(5, dim)), np.zeros((1, dim)), v[3:4], 1e-8 * v[3:4]])


@pytest.mark.parametrize("pivots", [None, 1, 300])
def test_equals_comparing_everything(spark, tmp_path, pivots):
    v, q = grouped(1)
    left, right = vectors(spark, v, "id").repartition(5), vectors(spark, q, "qid")
    path = str(tmp_path / "v")
    vi.build_vectors(left, path, pivots)
    for k in (1, 6):
        assert rows(vi.search_vectors(spark, path, right, k)) == rows(se.cosine_topk(left, right, k))


def test_most_vectors_are_not_compared(spark, tmp_path):
    v, q = grouped(2, n=4000, groups=60)
    path = str(tmp_path / "v")
    vi.build_vectors(vectors(spark, v[30:], "id"), path)
    assert vi.search_share(spark, path, vectors(spark, q[:10], "qid"), 5) < 0.15


def test_more_asked_for_than_there_is_and_groups_of_queries(spark, tmp_path, monkeypatch):
    v, q = grouped(3, n=60, groups=4)
    path = str(tmp_path / "v")
    vi.build_vectors(vectors(spark, v, "id"), path)
    left, right = vectors(spark, v, "id"), vectors(spark, q, "qid")
    assert rows(vi.search_vectors(spark, path, right, 100)) == rows(se.cosine_topk(left, right, 100))
    monkeypatch.setattr(vi, "MAX_NUMBERS", 40)
    assert rows(vi.search_vectors(spark, path, right, 3)) == rows(se.cosine_topk(left, right, 3))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "v")
    vi.build_vectors(vectors(spark, np.zeros((0, 4)), "id"), path)
    assert vi.search_vectors(spark, path, vectors(spark, np.ones((2, 4)), "qid")).count() == 0
    vi.build_vectors(vectors(spark, np.zeros((3, 4)), "id"), str(tmp_path / "zeros"))
    assert rows(vi.search_vectors(spark, str(tmp_path / "zeros"), vectors(spark, np.ones((1, 4)), "qid"), 2)) == [(0, 1, 0, 0.0), (0, 2, 1, 0.0)]
