import math
from collections import Counter

import numpy as np
import pytest

from docwarden.llm import near_vectors as nv
from docwarden.llm.near_vectors import ADDED, near_vectors


def brute(rows, cosine=0.93):
    """``rows`` are (key, vector, label); per row: links, least key of the component, kept."""
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for kind in {(rows[i][2], len(rows[i][1])) for i in good}:
        mine = [i for i in good if (rows[i][2], len(rows[i][1])) == kind]
        x = np.array([rows[i][1] for i in mine], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for p, q in zip(*np.nonzero(x @ x.T >= cosine)):
            if p != q:
                links[mine[p]].add(mine[q])
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out |= {j: (len(links[j]), least, rows[j][0] == least) for j in group}
    return out


def group(r, centre, n, spread):
    """``n`` directions whose cosine to ``centre`` is about ``1 / sqrt(1 + spread ** 2)``."""
    noise = r.normal(size=(n, len(centre))) / math.sqrt(len(centre))
    return (centre / np.linalg.norm(centre) + spread * noise) * r.uniform(0.1, 10, (n, 1))


def planted(seed, dim=32):
    r = np.random.default_rng(seed)
    rows = [(v, label) for label in (0, 1) for v in r.normal(size=(150, dim))]
    shared = r.normal(size=dim)
    rows += [(v, 1) for v in group(r, shared, 120, 0.1)] + [(v, 0) for v in group(r, shared, 5, 0.1)]
    rows += [(v, 1) for v in group(r, r.normal(size=dim), 60, 0.2)]
    rows += [(v, 0) for i in range(20) for v in group(r, r.normal(size=dim), 2 + i % 3, 0.12)]
    rows += [(rows[3][0], 0)] * 30 + [(rows[3][0] * 2, 0)]
    rows = [((i * 7919) % 10007, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]
    rows += [(rows[0][0], rows[0][1], 0), (rows[0][0], rows[5][1], 0), (None, rows[0][1], 0), (None, [0.5] * dim, 0), (20001, rows[0][1], None), (20002, None, 0), (20003, [], 0)]
    rows += [(20004, [0.0] * dim, 0), (20005, [math.nan] * dim, 0), (20006, [math.inf] * dim, 0), (20007, [None] * dim, 0), (20008, rows[0][1][:-1], 0), (20009, rows[0][1][:-1], 0)]
    rows += [(20010, [-0.0, 1.0], 3), (20011, [0.0, 1.0], 3), (20012, [1e-30, 1e38], 3)]
    return rows


def found(spark, rows, schema="vec_id long, embedding array<float>, label int", **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row int, {schema}").repartition(4)
    return {r["row"]: tuple(r[c] for c in ADDED) for r in near_vectors(df, **options).collect()}


def compare(got, rows, cosine=0.93):
    want = brute(rows, cosine)
    assert got.keys() == want.keys()
    have, whole = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert have >= 0.998 * whole
    assert all(got[i][0] <= want[i][0] for i in want)
    if have == whole:
        assert {i: (n, c) for i, (n, c, _) in got.items()} == {i: (n, c) for i, (n, c, _) in want.items()}


@pytest.mark.parametrize("block,cores", [(2048, True), (16, True), (16, False)])
def test_equals_brute_force(spark, block, cores):
    rows = planted(5)
    got = found(spark, rows, block=block, crowded_tables=cores)
    compare(got, rows)
    assert all(k == (rows[i][0] == c) for i, (_, c, k) in got.items())


def test_cores_hold_most_of_a_tight_group(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*group(r, r.normal(size=32), 400, 0.1), *r.normal(size=(200, 32))])]
    made = []
    whole = nv._candidates
    monkeypatch.setattr(nv, "_candidates", lambda dealt, limit: made.append(whole(dealt, limit)) or made[-1])
    listed = []
    stored = nv.Stored
    monkeypatch.setattr(nv, "Stored", lambda df, name, *a: (lambda s: listed.append(s.df.count()) or s if name == "candidate-pairs" else s)(stored(df, name, *a)))
    got = found(spark, rows, "vec_id long, embedding array<double>, label int")
    compare(got, rows)
    assert sum(listed) < 0.05 * 400 * 399 / 2


def test_recall_at_the_least_cosine(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a = r.normal(size=48)
        a /= np.linalg.norm(a)
        b = r.normal(size=48)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9301
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0)]
    got = found(spark, rows, "vec_id long, embedding array<double>, label int")
    assert sum(n for n, _, _ in got.values()) >= 0.99 * 800


def test_string_keys_and_clashing_columns(spark):
    rows = planted(6)
    named = [(None if k is None else f"k{k:05d}", v, None if label is None else f"l{label}") for k, v, label in rows]
    other = "cls string, id int, core int, n int, k int, v int, row string, Kept int, a int, key int, component string, grp int, least int"
    df = spark.createDataFrame([(i, *r, "c", 1, 2, 3, 4, 5, "r", 6, 7, 8, "d", 9, 10) for i, r in enumerate(named)], f"number int, vec_id string, embedding array<float>, label string, {other}")
    out = near_vectors(df)
    assert [c for c in out.columns if c not in ADDED] == [c for c in df.columns if c != "Kept"]
    got = {r["number"]: tuple(r[c] for c in ADDED) for r in out.collect()}
    compare(got, named)


def test_empty_and_nothing_usable(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None, 1), (2, [1.0], None)]) == {0: (0, 1, True), 1: (0, 2, True)}


def test_chances():
    r = np.random.default_rng(0)
    for distance in (0.2, 0.374, 1.41):
        a = r.normal(size=200_000) * distance
        shift = r.random(200_000) * nv.WIDTH
        share = np.mean(np.floor((a + shift) / nv.WIDTH) == 0)
        assert abs(share - nv.same_cell(distance)) < 0.005
    assert [nv.shape(n)[0] for n in (0, 64, 10_000, 10**9)] == sorted(nv.shape(n)[0] for n in (0, 64, 10_000, 10**9))


def test_buckets_do_not_depend_on_the_batch():
    x = np.random.default_rng(0).normal(size=(50, 16))
    group = np.arange(50).astype(np.uint64)
    whole = nv.bucket_names(x, group, 0, 5, 7, 1)
    assert (np.concatenate([nv.bucket_names(x[i : i + 1], group[i : i + 1], 0, 5, 7, 1) for i in range(50)]) == whole).all()
    assert (nv.bucket_names(x, group, 2, 4, 7, 1) == whole[:, 2:4]).all()


def test_meet_gives_each_pair_once():
    n = 300
    r = np.random.default_rng(0)
    part = {"key": np.sort(r.integers(0, 8, n)), "sub": np.zeros(n, np.int64), "id": np.arange(n), "core": r.integers(-1, 2, n), "side": r.integers(0, 3, n)}
    part |= {"s0": np.zeros(n, np.int64), "s1": np.zeros(n, np.int64)}
    got = Counter((int(a), int(b)) for i, j in nv._meet(part, 0) for a, b in zip(i, j))
    side, core, key = part["side"], part["core"], part["key"]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if key[a] == key[b] and (side[a] != side[b] or side[a] == 0) and (core[a] != core[b] or core[a] < 0)}
    assert set(got) == want and set(got.values()) == {1}
