import random
import re

import numpy as np
import pyarrow as pa

from docwarden.llm import text_bytes as tb


def test_words_as_the_pattern_finds_them(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " ", "a", " a b ", "é\x85x　y z"] + ["".join(rng.choice("ab é \n\t\x0b\x1f日") for _ in range(rng.randrange(60))) for _ in range(300)]
    for piece in (1 << 20, 16):
        monkeypatch.setattr(tb, "PIECE", piece)
        w = tb.words_of(pa.array(texts, pa.string()).slice(1))
        seen = {}
        for i, t in enumerate(texts[1:]):
            want = re.findall(r"[^\x20\x09-\x0D]+", t)
            a, b = w.first[i], w.first[i + 1]
            got = [w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(a, b)]
            assert got == want, repr(t)
            for k, x in zip(range(a, b), want):
                assert seen.setdefault(x, w.name[k]) == w.name[k]
        assert len(set(seen.values())) == len(seen)
        rows = [r for b in tb.row_chunks([pa.RecordBatch.from_pydict({"text": texts})], limit=50) for r in b.column("text").to_pylist()]
        assert rows == texts


def test_lower_and_long_word():
    w = tb.words_of(pa.array(["ABC abc " + "x" * (3 << 20) + " end"]), lower=True)
    assert len(w.name) == 4 and w.name[0] == w.name[1]
    assert tb.words_of(pa.array([], pa.string())).first.tolist() == [0]


def test_shingles():
    w = tb.words_of(pa.array(["a b c d e f", "b c d e f", "a b", ""]))
    name = [w.name[w.first[i] : w.first[i + 1]] for i in range(4)]
    sets = [tb.distinct_shingles(n) for n in name]
    assert [len(s) for s in sets] == [2, 1, 1, 0]
    assert np.isin(sets[1], sets[0]).all()
