import random
import re

import numpy as np
import pytest

from docwarden.llm import substring
from docwarden.llm.fm_index import FmIndex
from docwarden.llm.substring import remove_repeated_passages

SCHEMA = "doc_id long, text string, kept_text string, _x int"


def brute(rows, length):
    """Words, removed words and the text left of each (key, text), judged window by window."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            run = tuple(words[i : i + length])
            if run in seen:
                gone[i : i + length] = [True] * length
            seen.add(run)
        out[key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "old", 1) for k, t in rows], SCHEMA)
    return remove_repeated_passages(df, **options).collect()


@pytest.mark.parametrize("length, hot", [(20, 20_000), (9, 0)])
def test_against_brute_force(spark, length, hot):
    rng = random.Random(length)
    words = ["a", "bb", "ccc", "é", "dd,", "E"] + [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "x " * 200), (5, "x y " * 100), (6, "same text " * 30), (7, "same text " * 30)]
    for key in range(8, 90):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(6))]
        rows.append((key, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in result(spark, rows, length=length, hot_segments=hot, shard_words=400)}
    assert got == brute(rows, length)


def test_rows_that_share_an_id_and_rows_without(spark):
    text = " ".join(f"u{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "short")]
    got = result(spark, rows)
    assert len(got) == 5
    by = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in got}
    assert by == {(1, 30): 0, (None, 30): 30, (None, 0): 0, (2, 1): 0}
    assert result(spark, []) == []


def test_index_counts_every_run():
    rng = np.random.default_rng(2)
    for size in (3, 4, 50):
        s = np.append(rng.integers(1, size, 400), 0)
        index = FmIndex(s, size, 6)
        found, name = index.repeated(s, np.arange(395), 6)
        runs = [tuple(s[i : i + 6]) for i in range(395)]
        assert found.tolist() == [i for i in range(395) if runs.count(runs[i]) > 1]
        assert len(set(zip(name.tolist(), (runs[i] for i in found)))) == len(set(name.tolist()))


def test_a_common_passage_is_not_indexed_by_one_task(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(32))
    around = lambda i, side: " ".join(f"{side}{i}w{k}" for k in range(25))
    rows = [(i, f"{around(i, 'a')} {passage} {around(i, 'b')}") for i in range(60)]
    held, index = [], substring._index_shards

    def watched(contents, *options):
        held.extend(r["count"] for r in contents.groupBy("shard").count().collect())
        return index(contents, *options)

    monkeypatch.setattr(substring, "_index_shards", watched)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in result(spark, rows, hot_segments=20)}
    assert got == brute(rows, 20) and got[0][1] == 0 and got[59][1] == 32
    assert max(held, default=0) <= 20  # 60 before, one for each document
