import pytest
import math

import numpy as np
from pyspark.sql import functions as F

from docwarden.functions.vectors import cosine
from docwarden.operators import search as se
from docwarden.operators import word_index as wi


def texts(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "id long, content string")


def asked(spark, queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, text string")


def brute_force(contents, queries, k):
    """The BM25 formula, one document and one word at a time."""
    docs = [c.lower().split() for c in contents]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if w < 0 else w for t, w in idf.items()}
    out = []
    for qid, q in enumerate(queries):
        scores = [
            sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in q.lower().split()) for d in docs
        ]
        best = sorted(range(n), key=lambda i: (-round(scores[i], 8), i))[:k]
        out += [(qid, r + 1, i, round(scores[i], 6)) for r, i in enumerate(best)]
    return out


def rows(df):
    return [(r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in df.orderBy("qid", "rank").collect()]


CONTENTS = ["the red fox", "the blue fox fox", "", "a red red barn", "the the the", "quick fox　jumps", "THE red fox", "lonely words here", "a b c d e f g"]
QUERIES = ["red fox", "fox fox red", "absent", "the", "lonely", "", "A b absent b"]


def test_bm25(spark):
    got = rows(se.bm25_topk(texts(spark, CONTENTS), asked(spark, QUERIES), 4))
    assert got == brute_force(CONTENTS, QUERIES, 4)


def test_negative_weights_sort_below_zero(spark, monkeypatch):
    contents = ["same words", "same words", "same words", "same words", "", "same", ""] + ["same words"] * 30 + [""]
    queries = ["same", "words absent", "none"]
    got = rows(se.bm25_topk(texts(spark, contents), asked(spark, queries), 3))
    assert got == brute_force(contents, queries, 3)
    assert [g[2] for g in got[:3]] == [4, 6, 37]
    monkeypatch.setattr(se, "RUN_BYTES", 1)  # scored batch by batch
    assert rows(se.bm25_topk(texts(spark, contents).repartition(7), asked(spark, queries), 3)) == got


def test_more_asked_for_than_there_is(spark):
    got = rows(se.bm25_topk(texts(spark, ["x y", "z w", "q r"]), asked(spark, ["x"]), 10))
    assert got == brute_force(["x y", "z w", "q r"], ["x"], 10)


def test_empty_corpus(spark):
    assert se.bm25_topk(texts(spark, []), asked(spark, ["x"])).count() == 0
    assert se.bm25_topk(texts(spark, ["", " "]), asked(spark, ["x"])).count() == 0


def test_random_corpus_and_stored_index(spark, tmp_path):
    random = np.random.default_rng(5)
    words = [f"w{int(i)}" for i in random.zipf(1.4, 6000) % 400]
    contents = [" ".join(words[i * 20 : i * 20 + int(n)]) for i, n in enumerate(random.integers(0, 20, 300))]
    queries = [" ".join(random.choice(words, 6)) for _ in range(25)]
    want = brute_force(contents, queries, 5)
    docs, wanted = texts(spark, contents).repartition(5), asked(spark, queries)
    assert rows(se.bm25_topk(docs, wanted)) == want
    wi.build_index(docs, str(tmp_path / "index"))
    assert rows(wi.search_index(spark, str(tmp_path / "index"), wanted)) == want


def test_large_query_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(se, "MAX_BROADCAST_ROWS", 1)
    assert rows(se.bm25_topk(texts(spark, CONTENTS), asked(spark, QUERIES), 4)) == brute_force(CONTENTS, QUERIES, 4)


def vectors(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, embedding array<float>")


def test_cosine_both_ways(spark, monkeypatch):
    random = np.random.default_rng(7)
    v = random.normal(size=(500, 8)).astype("float32")
    v[10] = v[3]  # a tie
    v[20] = 0
    q = np.vstack([random.normal(size=(12, 8)), v[3:4]]).astype("float32")
    v64, q64 = v.astype("float64"), q.astype("float64")
    scores = (v64 @ q64.T) / np.maximum(np.linalg.norm(v64, axis=1)[:, None] * np.linalg.norm(q64, axis=1), 1e-9)
    want = [(j, r + 1, int(i), round(float(scores[i, j]), 6)) for j in range(len(q)) for r, i in enumerate(np.argsort(-scores[:, j], kind="stable")[:6])]
    left, right = vectors(spark, v, "id").repartition(3), vectors(spark, q, "qid")
    assert rows(se.cosine_topk(left, right, 6)) == want
    monkeypatch.setattr(se, "BLOCK_ROWS", 64)
    assert rows(se.cosine_topk(left, right, 6)) == want
    assert rows(se.cosine_topk(left, right, 6, max_shared=16)) == want


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.8) < 1e-12 and got[1] == 0.0


def length_and_as(text):
    return F.array(F.char_length(text).cast("float"), F.regexp_count(text, F.lit("a")).cast("float"))


def test_cache(spark, tmp_path):
    none = se.cache_table(spark, str(tmp_path / "missing"))
    assert none.count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="bad"):  # not taken for an empty cache, to which rows would be appended
        se.cache_table(spark, str(tmp_path / "bad")).count()
    first = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    cache = se.extend_cache(first, none, length_and_as)
    assert cache.count() == 2
    cache.write.parquet(str(tmp_path / "cache"))
    stored = se.cache_table(spark, str(tmp_path / "cache"))
    assert se.update_cache(first, str(tmp_path / "own"), length_and_as).count() == 2
    assert se.update_cache(first, str(tmp_path / "own"), length_and_as).count() == 2
    stored.write.mode("append").parquet(str(tmp_path / "own"))
    assert se.cache_table(spark, str(tmp_path / "own")).count() == 2
    more = first.unionAll(spark.createDataFrame([("caa",)], "text string"))
    assert [r["text"] for r in se.cache_misses(more, stored).collect()] == ["caa"]
    full = se.extend_cache(more, stored, length_and_as)
    got = {(r["text"], tuple(r["embedding"])) for r in se.embed_texts(more, full).collect()}
    assert got == {("a", (1.0, 1.0)), ("b", (1.0, 0.0)), ("caa", (3.0, 2.0))}
    assert se.embed_texts(more, stored).where("embedding IS NULL").count() == 1


def test_equal_vectors_tie_in_both_forms(spark):
    v = spark.createDataFrame([(i, [0.1, 0.7, 0.3]) for i in range(7)] + [(9, [1.0, 0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [0.3, 0.2, 0.1 + i]) for i in range(3)], "qid long, embedding array<float>")
    shared = sorted(map(tuple, se.cosine_topk(v, q, 4).collect()))
    assert shared == sorted(map(tuple, se.cosine_topk(v, q, 4, max_shared=1).collect()))
    assert [r[2] for r in shared if r[0] == 0] == [9, 0, 1, 2]


def test_index_by_vectors_and_by_words(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue bird")], "id long, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, "fox", [0.0, 1.0])], "qid long, text string, embedding array<float>")
    index = se.DocumentIndex(docs, vectors=vectors)
    assert index.mode == "dense" and index.search(asked, 1).first()["id"] == 2
    assert index.search(asked.drop("embedding"), 1).first()["id"] == 1

    def broken(text):
        raise ConnectionError("no service")

    assert se.DocumentIndex(docs, broken).search(asked.drop("embedding"), 1).first()["id"] == 1


def test_one_text_fills_a_third_of_the_rows(spark):
    many = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    none = spark.createDataFrame([], "content_key string, embedding array<float>")
    found = se.embed_texts(many, se.extend_cache(many, none, length_and_as))
    assert found.count() == 6000 and found.where("embedding[0] <> char_length(text)").count() == 0
    assert found.where("text = 'hot'").count() == 2000


def test_index_modes(spark):
    docs = texts(spark, ["a cat", "a dog", "some bird"]).withColumn("extra", F.lit("kept"))
    by_words = se.DocumentIndex(docs)
    assert by_words.mode == "bm25"
    best = by_words.search(asked(spark, ["dog"]), 1).first()
    assert (best["id"], best["extra"], best["rank"]) == (1, "kept", 1)
    dense = se.DocumentIndex(docs, provider=length_and_as)
    assert dense.mode == "dense" and dense.search(asked(spark, ["xyz a"]), 2).count() == 2
    off = se.DocumentIndex(docs, words=False)
    assert off.mode == "none" and off.search(asked(spark, ["dog"])).count() == 0


def test_words_are_counted_in_pieces():
    """A batch of any number of documents is counted a bounded number at a time."""
    import pyarrow as pa

    from docwarden.operators import scoring as sc

    tokens = [None if i % 7 == 0 else [f"w{i % 5}", "x", "x"] for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(tokens, pa.list_(pa.string()))], names=["id", "tokens"])
    pieces = list(sc.counted_batches(iter([batch])))
    assert max(p.num_rows for p in pieces) <= sc.COUNT_DOCS
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [r["id"] for r in rows] == list(range(2000))
    assert [dict(zip(r["words"], r["counts"])) for r in rows] == [{} if t is None else {t[0]: 1, "x": 2} for t in tokens]
