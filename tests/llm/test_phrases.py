import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docwarden.llm import phrases as ph
from docwarden.llm.phrases import Stream, least_cut, phrase_collocations, range_key, windows
from docwarden.llm.transducers import Transducer, compose, union


def brute(rows, frequent, best, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for d in range(1, longest + 1):
                counts[lang].update(w[i : i + d] for i in range(len(w) - d + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= frequent and len(p) > 1}
        inside = {g[i:j] for g, a in often.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1) if j - i < len(g) and f[g[i:j]] <= a}
        scored = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in phrase_collocations(df, **options).collect())


def corpus(seed, texts=300):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "日本", "naïve", "A1", "x y"]
    fixed = ["the Quick brown fox jumps over it", "w1 w1 w1 w1 w1 w1 w1", "only here always together", "é É é"]
    rows = []
    for i in range(texts):
        words = r.choice(vocabulary, size=r.integers(0, 60), p=np.arange(30, 0, -1) / 465).tolist()
        for _ in range(r.integers(0, 3)):
            words.insert(int(r.integers(0, len(words) + 1)), fixed[r.integers(0, 4)])
        glue = r.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", " ?! "], size=len(words), p=[0.6, 0.05, 0.05, 0.1, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(w + g for w, g in zip(words, glue)), ["en", "de", None, "und"][r.integers(0, 4)]))
    return rows + [(None, "en"), ("", "en"), (" \t.", "fr"), (None, None)] + rows[:20] * 3


@pytest.mark.parametrize("options", [{}, {"words_per_range": 150, "phrases_per_range": 10}, {"words_per_range": 1000, "phrases_per_range": 40, "longest": 3}])
def test_equals_brute_force(spark, options):
    rows = corpus(1)
    got = found(spark, rows, frequent=6, best=40, **options)
    assert got == brute(rows, 6, 40, options.get("longest", 5)) and len(got) > 60


def test_one_very_common_pair_and_ties(spark):
    rows = [(f"hot pair a{i % 40} b{i % 7}", "en") for i in range(900)] + [(f"p{i % 50} q{i % 50}", "de") for i in range(500)]
    got = found(spark, rows, frequent=5, best=30, words_per_range=100, phrases_per_range=16)
    assert got == brute(rows, 5, 30)
    assert sum(r[0] == "de" for r in got) == 30


def test_nothing_frequent_and_empty(spark):
    assert found(spark, [("a b c", "en"), (None, None)]) == []
    assert found(spark, []) == []


def test_clashing_columns(spark):
    rows = [(t, l, 1, 2, 3, 4, "x", "y") for t, l in corpus(2, 60)]
    df = spark.createDataFrame(rows, "content string, tongue string, l int, t int, n int, word int, lang string, gram string")
    got = sorted(tuple(r) for r in phrase_collocations(df, text="content", lang="tongue", frequent=5, best=9).collect())
    assert got == brute([r[:2] for r in rows], 5, 9)


def test_a_long_text_is_read_whole(spark):
    rows = [("u v " * 700_000 + "u v", "en"), ("v u", "en")]
    assert found(spark, rows, frequent=100) == brute(rows, 100, 2000)


def test_scores_are_exact(spark):
    r = np.random.default_rng(0)
    rows = []
    for _ in range(200):
        a = int(r.integers(100, 10**12))
        parts = [int(a + r.integers(0, 10 ** int(r.integers(1, 13)))) for _ in range(4)]
        rows.append((a, int(r.integers(10**12, 10**15)), parts[:2], parts[2:]))
    rows.append((10**12, 10**15, [10**12, 10**12], [10**12, 10**12 + 1]))
    df = spark.createDataFrame(rows, "a long, total long, f array<long>, l array<long>")
    got = df.select("a", "total", "f", "l", least_cut("a", "total", "f", "l").alias("c")).collect()
    for x in got:
        score, k = min((1000 * x["a"] * x["total"] // (p * q), k) for k, (p, q) in enumerate(zip(x["f"], x["l"])))
        assert (x["c"]["score"], x["c"]["k"], x["c"]["first"], x["c"]["last"]) == (score, k, x["f"][k], x["l"][k])


def paths_of(r, rows, names=6, depth=4):
    path = r.integers(1, names, (rows, depth)).astype(np.uint64) * np.uint64(1 << 60)
    for i, n in enumerate(r.integers(1, depth + 1, rows).tolist()):
        path[i, n:] = 0
    return path


def prefixes(path):
    out = Counter()
    for p in path.tolist():
        p = tuple(x for x in p if x)
        out.update(p[: d + 1] for d in range(len(p)))
    return out


def states_of(t):
    out = {}
    for d in range(1, t.path.shape[1] + 1):
        first, n = t.states(d)
        out |= {tuple(t.names[t.path[f, :d]].tolist()): w for f, w in zip(first, n.tolist())}
    return out


def test_transducers_count_prefixes():
    r = np.random.default_rng(0)
    for rows in (0, 1, 5, 400):
        paths = [paths_of(r, rows), paths_of(r, 30, names=15), paths_of(r, rows, names=3)]
        parts = [Transducer.unpack(Transducer.of(p).pack()) for p in paths]
        for p, t in zip(paths, parts):
            assert states_of(t) == prefixes(p)
        assert states_of(union(parts)) == prefixes(np.concatenate(paths))


def test_compose_gives_counts_of_prefixes():
    r = np.random.default_rng(1)
    counts = prefixes(paths_of(r, 500))
    path = np.zeros((len(counts), 4), dtype=np.uint64)
    for i, p in enumerate(counts):
        path[i, : len(p)] = p
    n = np.array(list(counts.values()))
    t = Transducer.of(path, np.arange(len(n)))
    weights, longer = compose(Transducer(t.names, t.path, n[t.weight]), (path > 0).sum(axis=1)[t.weight])
    for i, w, more in zip(t.weight.tolist(), weights.tolist(), longer.tolist()):
        p = tuple(x for x in path[i].tolist() if x)
        assert w == [counts[p[: d + 1]] if d < len(p) else 0 for d in range(4)]
        assert more == max((c for q, c in counts.items() if q[:-1] == p), default=0)


def test_prefixes_are_ranges_of_keys():
    r = np.random.default_rng(2)
    path = r.integers(1, 1 << 62, (50, 6)).astype(np.uint64)
    for d in range(1, 6):
        start = path.copy()
        start[:, d + 1 :] = 0
        assert (range_key(start) <= range_key(path)).all() and (range_key(path) <= range_key(start, 1)).all()


def test_windows_stop_at_pieces_and_rare_words(monkeypatch):
    s = Stream(pa.array(["a b. c d\x0be f g h i j", None, "k", "l"]), ["x", "x", "x", "y"])
    every = np.full(ph.FILTER_BITS // 8, 255, dtype=np.uint8)
    monkeypatch.setattr(ph, "SHARD", 4)
    text = dict(zip(s.name.tolist(), "abcdefghijkl"))
    got = ["".join(text[x] for x in p[1:] if x) for n, w in windows(s, every) for p in n[w].tolist()]
    assert got == ["ab", "b", "cd", "d", "efghi", "fghij", "ghij", "hij", "ij", "j", "k", "l"]
    rare = every.copy()
    bit = int(ph._bit(s.lang_names()[s.lang], s.name)["abcdefghijkl".index("g")])
    rare[bit >> 3] &= ~np.uint8(1 << (bit & 7))
    got = ["".join(text[x] for x in p[1:] if x) for n, w in windows(s, rare) for p in n[w].tolist()]
    assert got == ["ab", "b", "cd", "d", "ef", "f", "hij", "ij", "j", "k", "l"]
    pairs = every.copy()
    bit = int(ph._bit(s.lang_names()[s.lang], s.name, np.roll(s.name, -1))["abcdefghijkl".index("e")])
    pairs[bit >> 3] &= ~np.uint8(1 << (bit & 7))
    got = ["".join(text[x] for x in p[1:] if x) for n, w in windows(s, every, pairs, 3, 2) for p in n[w].tolist()]
    assert got == ["ab", "cd", "fgh", "ghi", "hij", "ij"]
