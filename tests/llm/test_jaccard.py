import random
import re
from itertools import combinations

import pytest

from docwarden.llm import jaccard
from docwarden.llm.components import connected_components
from docwarden.llm.jaccard import jaccard_groups


def sets_of(rows, length=5):
    out = []
    for key, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = min(length, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def brute(rows, percent=80):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = {}
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (len(sets[i]), min(keys, default=None))
    return out


def near_copies(rng, n):
    words = [f"w{i}" for i in range(500)]
    rows = [(1000, None), (1001, ""), (1002, " \t "), (1003, "a"), (1004, "A"), (1005, "a b c d"), (1006, "a b c d e")]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 30, 60, 200, 900]))]
        for _ in range(n):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(text) // 25)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(words)]
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + " " + passage) for i in range(15)]
    return rows


@pytest.mark.parametrize("keys, sample", [(4, 5000), (0, 20)])
def test_against_brute_force(spark, monkeypatch, keys, sample):
    """Also without likely links and with a poor sample, which change the work only."""
    monkeypatch.setattr(jaccard, "KEYS", keys)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    rng = random.Random(keys)
    rows = near_copies(rng, 9)
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_shingles int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(df).collect()}
    assert got == {rows[i][0]: v for i, v in brute(rows).items()}


def test_shared_and_missing_keys(spark):
    rows = [(5, "a b c d e f"), (5, "q r s"), (None, "a b c d e f"), (None, "z"), (None, None), (2, "q R s"), (9, "x"), (9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_shingles"], r["component_id"]) for r in jaccard_groups(df).collect())
    want = sorted((str(k), str(t), *v) for (k, t), v in zip(rows, brute(rows).values()))
    assert got == want
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
