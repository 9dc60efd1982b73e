import random
from collections import Counter

import pytest

from docwarden.llm import language as lg


def brute_grams(text):
    out = Counter()
    for word in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip() and not (n == 1 and g == " "):
                    out[g] += 1
    return out


def number(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


@pytest.mark.parametrize("window", [1 << 18, 9])
def test_grams_are_those_of_words(monkeypatch, window):
    monkeypatch.setattr(lg, "WINDOW", window)
    for text in ["", "a", "Hello, World!", " x  y ", "été ß Ünder 12ab", "日本 語", "it's"]:
        want = Counter({number(g): n for g, n in brute_grams(text).items()})
        assert Counter(lg.text_grams(text).tolist()) == want, text


def test_against_brute_force(spark):
    rng = random.Random(6)
    stems = {"aa": ["tor", "bel", "mia"], "bb": ["tor", "zuk", "oxo"], "cc": ["éla", "ñor", "bel"]}
    rows = []
    for i in range(90):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30))), lang))
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 !", "cc"), (103, "tor bel", None), (103, "tor bel", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 25
    profiles = lg.language_profiles(df, size=size)
    got = lg.identify_language(df, profiles, size=size).collect()
    counts = {}
    for _, t, lang in rows:
        if t and lang:
            counts.setdefault(lang, Counter()).update({number(g): n for g, n in brute_grams(t).items()})
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]
    want = {k: top(c) for k, c in counts.items()}
    learned = {}
    for r in profiles.orderBy("lang", "rank").collect():
        learned.setdefault(r["lang"], []).append(r["gram"])
    assert learned == want
    for r in got:
        own = top(Counter({number(g): n for g, n in brute_grams(r["text"]).items()}))
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(own)) for k, p in want.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - far[best] / (size * len(own)))
    assert len(got) == len(rows)


def test_no_profiles_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    profiles = lg.language_profiles(df)
    assert profiles.count() == 0
    assert lg.identify_language(df, profiles).first()["lang_pred"] == "und"
    assert lg.identify_language(df.limit(0), profiles).count() == 0


def test_windows_cut_no_word(monkeypatch):
    import re
    from collections import Counter

    import numpy as np

    from docwarden.llm import language

    def plain(text):
        words = re.findall(r"[^\W\d_]+", text)
        out = Counter()
        line = " " + " ".join(w.lower() for w in words) + " "
        if words:
            out.update(c for c in line if c != " ")
            out.update(line[i : i + 2] for i in range(len(line) - 1))
            out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
        return out

    def named(text):
        out = Counter()
        for g in language.text_grams(text).tolist():
            chars = []
            while g:
                chars.append(chr(g & 0x1FFFFF))
                g >>= 21
            out["".join(reversed(chars))] += 1
        return out

    r = np.random.default_rng(0)
    texts = ["", " ", "a", "1", "ab", "a b", " a  b1c ", "x" * 30] + ["".join(r.choice(list("abcé  1"), r.integers(1, 60))) for _ in range(200)]
    for window in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(language, "WINDOW", window)
        for t in texts:
            assert named(t) == plain(t), (window, t)
    assert len(language.text_grams("a" * 600_000)) == 600_000 + 600_001 + 600_000
