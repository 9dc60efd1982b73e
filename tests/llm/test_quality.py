import random
import re

import numpy as np
import pyarrow as pa

from docwarden.llm.quality import COUNTS, FEATURES, batch_statistics, fit_quality, grow_trees, quality_rules, score_rows


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(threes) if threes.count(t) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n", "a", "a a a a", "#\n#\n #\n\n\n", "é ü\x85x 日本\n日本"]
    return out + ["".join(rng.choice(["a ", "b ", "c ", "dé ", "#", "\n", "\t", "|", "X", "9"]) for _ in range(rng.randrange(90))) for _ in range(150)]


def test_counts_against_brute_force(spark):
    rows = texts(2)
    counts, x = batch_statistics(pa.array(rows, pa.string()))
    assert x.shape == (len(rows), len(FEATURES)) and np.isfinite(x).all()
    assert [tuple(int(counts[c][i]) for c in COUNTS) for i in range(len(rows))] == [brute(t) for t in rows]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(rows)] + [(None, "z", "old")], "doc_id long, text string, kept string")
    trees = fit_quality(df, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_rules(df, trees).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = brute(r["text"])
        assert tuple(r[c] for c in COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules(df.limit(0), trees).count() == 0


def test_trees_learn_and_keep_their_signs():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] < 0.4) & (x[:, 1] > 0.2) | (rng.random(3000) < 0.05)).astype(float)
    signs = [-1, 0, 1, 0]
    trees = grow_trees(x, y, signs, trees=40)
    assert ((score_rows(trees, x) > 0.5) == (y > 0)).mean() > 0.93
    for f, sign in ((0, -1), (2, 1)):
        base = rng.random((400, 4))
        more = base.copy()
        more[:, f] += rng.random(400)
        assert (sign * (score_rows(trees, more) - score_rows(trees, base)) >= -1e-12).all()

    def walk(row):
        z = trees.base
        for at in trees.root:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            z += trees.value[at]
        return 1 / (1 + np.exp(-z))

    assert np.allclose([walk(r) for r in x[:50]], score_rows(trees, x[:50]))
    none = grow_trees(np.zeros((0, 4)), np.zeros(0), signs, trees=2)
    assert np.allclose(score_rows(none, x[:3]), 0.5)
