import random

import numpy as np
import pyarrow as pa
import pytest

from docwarden.llm import toxicity as tx


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        t = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        for _ in range(rng.randrange(2, 5) if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["Vexish", "vexing", "drolby"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return rows, labels


def test_features_are_those_of_each_text_alone(monkeypatch):
    texts = ["ab c", None, "Ab, C!", "", "xyz" * 40, "xyz" * 40]
    whole = tx.batch_features(pa.array(texts, pa.string()))
    for piece in (1 << 18, 7):
        monkeypatch.setattr(tx, "_PIECE", piece)
        row, bucket, value = tx.batch_features(pa.array(texts, pa.string()))
        assert all((a == b).all() for a, b in zip(whole, (row, bucket, value)))
        for i, t in enumerate(texts):
            alone = tx.batch_features(pa.array([t], pa.string()))
            assert (alone[1] == bucket[row == i]).all() and np.allclose(alone[2], value[row == i])
    sets = [set(whole[1][whole[0] == i].tolist()) for i in range(6)]
    assert sets[0] - {min(sets[0])} and sets[4] == sets[5] and not sets[1] - sets[3]


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 900)
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    known = spark.createDataFrame([x for x in labels if x[0] % 3 != 1] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = tx.fit_toxicity(docs.where("doc_id % 3 <> 1"), known)
    got = {r["doc_id"]: r["score"] for r in tx.score_toxicity(docs, model).collect()}
    assert len(got) == 900 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, y in labels if i % 3 == 1]
    caught = [s >= 0.7 for s, y in held if y]
    assert sum(caught) >= 0.95 * len(caught) and sum(s >= 0.7 for s, y in held if not y) <= 2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "word " * 50_000), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit_toxicity(docs, none)
    assert len(model.bucket) == 0 and tx.score_toxicity(docs, model).count() == 5
    assert tx.score_toxicity(docs.limit(0), model).count() == 0
    one = tx.fit_toxicity(docs, spark.createDataFrame([(2, 1)], "doc_id long, toxic int"))
    scores = [r["score"] for r in tx.score_toxicity(docs, one).collect()]
    assert len(set(scores)) == 1 and scores[0] > 0.5
