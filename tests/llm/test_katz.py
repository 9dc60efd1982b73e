import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm.katz import DISCOUNTED, discounts, katz_scores, pack, unpack


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Brute:
    """The same model word by word."""

    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for t in texts:
            w = tokens_of(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>"] + w, w))
            self.ctx.update(["<s>"] + w[:-1])
        self.n = sum(self.uni.values())
        spectrum = lambda c: [sum(v == k for v in c.values()) for k in range(1, DISCOUNTED + 2)]
        self.du, self.db = discounts(spectrum(self.uni)), discounts(spectrum(self.bi))
        self.unknown, self.scale = 1 - sum(self.f(self.du, c) * c for c in self.uni.values()) / self.n if self.n else 1.0, 1.0
        if self.unknown <= 1e-12:
            self.unknown, self.scale = 1 / (self.n + 1), self.n / (self.n + 1)
        self.after = defaultdict(list)
        for u, v in self.bi:
            self.after[u].append(v)

    @staticmethod
    def f(d, c):
        return d[c] if c <= DISCOUNTED else 1.0

    def p1(self, w):
        c = self.uni[w]
        return self.scale * self.f(self.du, c) * c / self.n if c else self.unknown

    def p2(self, u, w):
        if not self.ctx[u]:
            return self.p1(w)
        mass = sum(self.f(self.db, self.bi[u, v]) * self.bi[u, v] for v in self.after[u]) / self.ctx[u]
        full = mass > 1 - 1e-9
        if self.bi[u, w]:
            p = self.f(self.db, self.bi[u, w]) * self.bi[u, w] / self.ctx[u]
            return p * self.ctx[u] / (self.ctx[u] + 1) if full else p
        free = 1 / (self.ctx[u] + 1) if full else 1 - mass
        return free / (1 - sum(self.p1(v) for v in self.after[u])) * self.p1(w)

    def score(self, text):
        w = tokens_of(text)
        return sum(math.log10(self.p2(u, v)) for u, v in zip(["<s>"] + w, w))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (len(self.uni) + 1))) for w in tokens_of(text))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"W{int(rng.expovariate(0.1))}" for _ in range(4000)]
    texts = [None, "", " ", "a", "A a"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(n)]
    return [(i, t, i % 5 != 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("n, cell", [(300, 2000), (300, 1 << 23), (0, 10)])
def test_against_brute_force(spark, n, cell):
    rows = corpus(n, n)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, learn boolean, score string")
    got = {r["key"]: r for r in katz_scores(df, F.col("learn"), cell_bytes=cell, bucket_keys=200).collect()}
    model = Brute([t for _, t, learn in rows if learn])
    assert len(got) == len(rows)
    for key, text, learn in rows:
        r = got[key]
        words = tokens_of(text)
        assert (r["train"], r["n_tokens"], r["train_tokens"]) == (learn, len(words), model.n)
        assert r["n_known"] == sum(model.uni[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(model.base(text), abs=1e-9)
        assert r["score"] == pytest.approx(model.score(text), abs=1e-6)


def test_probabilities_add_up():
    model = Brute([t for _, t, learn in corpus(3, 100) if learn])
    for u in list(model.ctx)[:40]:
        assert sum(model.p2(u, w) for w in [*model.uni, "\0unseen"]) == pytest.approx(1, abs=1e-9)


def test_without_training_or_rows(spark):
    df = spark.createDataFrame([(None, "a b", None), (None, None, False)], "doc_id long, text string, learn boolean")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in katz_scores(df, F.col("learn")).collect())
    assert got == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert katz_scores(df.limit(0), F.col("learn")).count() == 0


def test_packing():
    x = np.array([0, 5, -7, 1 << 60])
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0


def test_discounts_by_hand():
    # n_r = C / r^2: r* / r = r / (r + 1), of which 1 / 6 is left to the count 6.
    assert discounts([3600, 900, 400, 225, 144, 100]) == pytest.approx([1, 0.4, 0.6, 0.7, 0.76, 0.8])
    # n_r = C / r, the limit: 1 - log((r + 1) / r) / log 6.
    assert discounts([60, 30, 20, 15, 12, 10]) == pytest.approx([1, 0.613147, 0.773706, 0.839441, 0.875461, 0.898244], abs=1e-6)
    # A gap: n_1 = 40 over (2 - 0) / 2, n_2 = 10 over (4 - 1) / 2, n_4 = 3 over (6 - 2) / 2; slope of logs through them.
    slope = np.polyfit(np.log([1, 2, 4]), np.log([40, 10 / 1.5, 3 / 2]), 1)[0]
    want = [((r + 1) / r) ** (slope + 1) - 6 ** (slope + 1) for r in range(1, 6)]
    assert discounts([40, 10, 0, 3, 0, 0])[1:] == pytest.approx([w / (1 - 6 ** (slope + 1)) for w in want])


# Unigrams and bigrams of the training fold at sf0.1, whose n_5 is above the line.
@pytest.mark.parametrize("n", [[215810, 61309, 26017, 14862, 13741, 7222], [1655711, 262472, 56325, 23262, 20048, 8151]])
def test_discounts_are_good_turing_on_uneven_counts(n):
    d = discounts(n)
    x, y = np.log(np.arange(1, 7)), np.log(n)
    b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    want = [(((r + 1) / r) ** (b + 1) - 6 ** (b + 1)) / (1 - 6 ** (b + 1)) for r in range(1, 6)]
    assert d[1:] == pytest.approx(want) and (np.diff(d[1:]) > 0).all() and (d[1:] > 0).all() and (d[1:] < 1).all()
    absolute = n[0] / (n[0] + 2 * n[1])  # the factors before
    assert abs(d[2:] - (1 - absolute / np.arange(2, 6))).min() > 0.05


def test_discounts_without_a_line():
    assert discounts([7, 0, 0, 0, 0, 0])[1:] == pytest.approx([(r - 0.9) / r for r in range(1, 6)])
    assert (discounts([0, 4, 2, 0, 0, 0]) == 1).all() and (discounts([0] * 6) == 1).all()
