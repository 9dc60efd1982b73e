import hashlib
import random
import shutil

import pytest

import corpus_pipeline as cp
from docwarden.llm.queries import vocabulary_path
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_passages import brute_leaks
from tests.llm.test_substring import brute as brute_passages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC = ["idiot", "scum", "moron"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic documents, copies, passages, leaks, nulls and a repeated row."""
    out = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(400)]
    text_of = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text_of(rng.randrange(15, 50)))) for i in range(8)]
    passage = text_of(60)
    rows, labels = [(0, None), (1, ""), (2, " \n "), (3, "One"), (None, "no id here")], []
    for i in range(4, 300):
        t = text_of(rng.randrange(30, 120))
        toxic = i % 6 == 0
        if toxic:
            t += rng.sample(TOXIC, 3) + text_of(5)
        if i % 10 == 3:
            t = t[:20] + passage + t[20:]
        if i % 25 == 7:
            t = t + items[i % 8][1].split()
        if i % 9 == 5 and rows[-1][1]:
            t = rows[-1][1].split() + [rng.choice(words)]
            toxic = any(x in TOXIC for x in t)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    rows.append(rows[-2])
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLUMNS)
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    yield str(out), items
    shutil.rmtree(out)


def test_stages_against_brute_force(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before = pairs(docs)

    clean = cp.materialise(cp.drop_toxic(spark, docs, path), "a")
    assert clean.columns == docs.columns
    stay = [str(r) for r in before if not set(TOXIC) & set((r[1] or "").split())]
    left = list(map(str, pairs(clean)))
    assert set(left) <= set(map(str, before))
    assert len(set(stay) - set(left)) <= 3 and len(set(left) - set(stay)) <= 0.1 * (len(before) - len(stay))

    single = cp.materialise(cp.drop_near_copies(spark, clean, path), "b")
    rows = pairs(clean)
    groups = brute_groups(rows)
    want = {rows[i] for i, (_, c) in groups.items() if c == rows[i][0]}
    assert sorted(map(str, pairs(single))) == sorted(map(str, want))

    cut = cp.materialise(cp.cut_repeated_passages(spark, single, path), "c")
    rows = pairs(single)
    gone = brute_passages(rows, 20)
    want = [(k, gone[k][2] if gone[k][1] else t) for k, t in rows if not gone[k][1] or gone[k][1] < gone[k][0]]
    assert sorted(map(str, pairs(cut))) == sorted(map(str, want))
    assert any(gone[k][1] for k, _ in rows)

    safe = cp.materialise(cp.drop_leaks(spark, cut, path), "d")
    rows = pairs(cut)
    assert sorted(map(str, pairs(safe))) == sorted(str(r) for r in rows if not brute_leaks(r[1], items))
    assert safe.count() < cut.count()

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    encoded = {r["doc_id"]: r for r in cp.encode(spark, safe, path).collect()}
    for key, text in pairs(safe):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert encoded[key]["ids"] == ids and encoded[key]["n_tokens"] == len(ids)
        assert encoded[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(map(str, cp.run(spark, path).collect())) == sorted(map(str, encoded.values()))


def test_stages_are_named_and_return_documents(spark, folder):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, empty, path)
        assert out.columns == empty.columns and out.count() == 0, name
    assert cp.STAGES[-1][1](spark, empty, path).count() == 0
