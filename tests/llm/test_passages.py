import random
import re
from collections import Counter

import numpy as np
import pytest

from docwarden.llm import passages
from docwarden.llm.decontaminate import MultiIndex, find_leaks
from docwarden.llm.licenses import TEMPLATES, bands_for, scan_licenses, window_shape


def words_in(text, plain=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    if plain:
        text = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(words):
    n = min(5, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for _ in range(400)]
    queries = np.array([int(base[i % 40]) ^ f for i, f in enumerate(flips)], dtype=np.uint64)
    for radius in (0, 5, 12):
        got = set(zip(*(x.tolist() for x in MultiIndex(base, radius).near(queries))))
        want = {(i, j) for i in range(400) for j in range(40) if (int(queries[i]) ^ int(base[j])).bit_count() <= radius}
        assert got == want


def brute_leaks(text, items):
    df = Counter(s for _, t in items for s in set(shingles(words_in(t))))
    words = words_in(text)
    out = {}
    for key, t in items:
        item = words_in(t)
        if not item or not words:
            continue
        mine, width = Counter(shingles(item)), min(5, len(item))
        n = min(len(item), len(words))
        for start in range(len(words) - n + 1):
            window = words[start : start + n]
            theirs = Counter(tuple(window[i : i + width]) for i in range(n - width + 1))
            weight = lambda c: sum(k / df.get(s, 1) for s, k in c.items())
            both = weight(mine & theirs)
            whole = weight(mine) + weight(theirs) - both
            if both and both / whole >= 0.8 - 1e-12 and both / whole > out.get(key, (0,))[0] + 1e-12:
                out[key] = (both / whole, start)
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    text_of = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text_of(rng.randrange(15, 60))) for i in range(25)] + [(100, None), (101, ""), (102, "four short words here"), (103, "Zz")]
    items.append((104, items[0][1]))
    docs = [(0, None), (1, ""), (2, "zz"), (3, items[3][1]), (4, items[4][1].upper()), (5, " ".join(items[5][1].split()[:-1]))]
    for i in range(6, 80):
        parts = [text_of(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(25)][1].split()
            if rng.random() < 0.5:
                w[rng.choice([0, -1, rng.randrange(len(w))])] = "other"
            parts += [" ".join(w), text_of(rng.randrange(30))]
        docs.append((i, "\n".join(parts)))
    docs.append((6, docs[6][1]))
    df = spark.createDataFrame([(k, t, "old") for k, t in docs], "doc_id long, text string, leaks string")
    got = find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), radius=20).collect()
    assert len(got) == len(docs)
    n = 0
    for r in got:
        want = brute_leaks(r["text"], items)
        assert {x["item"]: (round(x["similarity"], 9), x["start"]) for x in r["leaks"]} == {k: (round(s, 9), a) for k, (s, a) in want.items()}
        n += len(want)
    assert n > 60


def test_exact_passages_are_found_with_the_default_radius(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"x{rng.randrange(900)}" for _ in range(rng.randrange(15, 60)))) for i in range(30)]
    docs = [(i, f"before {t} after words") for i, t in items]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all([x["item"] for x in r["leaks"]] == [r["doc_id"]] and r["leaks"][0]["start"] == 1 for r in got)


def test_no_items_and_no_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).collect()[0]["leaks"] == []
    assert find_leaks(docs.limit(0), none).count() == 0


def brute_licenses(text, templates):
    words = words_in(text, plain=True)
    out = {}
    for key, t in templates:
        own = words_in(t, plain=True)
        if not own:
            continue
        mine, width = set(shingles(own)), min(5, len(own))
        size, step = window_shape(len(own))
        for start in range(0, len(words), step):
            window = words[start : start + size]
            share = len(mine & {tuple(window[i : i + width]) for i in range(len(window) - width + 1)}) / len(mine)
            if share >= 0.8 and share > out.get(key, (0,))[0]:
                out[key] = (share, start)
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(10)
    filler = [f"t{i}" for i in range(90)]
    docs = [(0, None), (1, ""), (2, "MIT"), (3, TEMPLATES[0][1].upper() + "!"), (3, TEMPLATES[0][1].upper() + "!")]
    for i in range(4, 90):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(TEMPLATES)[1].split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = "other"
            parts += [" ".join(rng.choice(filler) for _ in range(rng.randrange(30))), " ".join(w)]
        docs.append((i, "\n".join(parts)))
    templates = [*TEMPLATES, ("empty", ""), ("none", None), ("short", "All rights reserved")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = scan_licenses(df, spark.createDataFrame(templates, "template string, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_licenses(r["text"], templates)
        assert {x["template"]: (x["containment"], x["start"]) for x in r["licenses"]} == want, r["text"]
    assert sum(len(r["licenses"]) for r in got) > 60
    assert scan_licenses(df.limit(0), spark.createDataFrame(templates, "template string, text string")).count() == 0


def test_bands():
    for words in (5, 7, 20, 60):
        bands, rows = bands_for(words, 5, 0.8, 1e-4)
        size, step = window_shape(words)
        assert size >= words + step - 1 and bands >= 1 and rows in (1, 2)


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(15)
    text_of = lambda n: [f"y{rng.randrange(500)}" for _ in range(n)]
    frame = text_of(30)  # shared by the items, so their own words weigh more
    items = [(i, " ".join(frame + text_of(12))) for i in range(12)] + [(20, "zz"), (21, "zz")]
    docs = [(i, " ".join([*text_of(5), *t.split()[:-1], "other", *text_of(5)])) for i, t in items[:12]] + [(30, None), (31, "zz"), (32, " ".join(frame))]
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(passages, "BLOCK_TEXTS", 4)
    got = find_leaks(*given, radius=30).collect()
    assert given[0].columns + ["leaks"] == list(got[0].asDict())
    for r in got:
        assert {x["item"]: round(x["similarity"], 9) for x in r["leaks"]} == {k: round(s, 9) for k, (s, _) in brute_leaks(r["text"], items).items()}
    assert sum(len(r["leaks"]) for r in got) > 10
