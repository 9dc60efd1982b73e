import numpy as np
import pytest

from docwarden.operators import scoring as sc
from docwarden.operators import word_index as wi
from docwarden.sources import snapshots
from tests.test_search import CONTENTS, QUERIES, asked, brute_force, rows


def texts(spark, contents, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], c) for i, c in enumerate(contents)], "id long, content string")


def corpus(seed, docs=400, words=60):
    random = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(words)])
    weight = 1 / np.arange(1, words + 1) ** 1.1
    return [" ".join(random.choice(vocabulary, n, p=weight / weight.sum())) for n in random.integers(0, 30, docs)]


def best(spark, path, contents, queries, k):
    return rows(wi.search_index(spark, path, asked(spark, queries), k)), brute_force(contents, queries, k)


@pytest.mark.parametrize("block", [1, 7, 512])
def test_search_equals_brute_force(spark, tmp_path, block):
    contents = corpus(block)
    random = np.random.default_rng(1)
    queries = [" ".join(f"w{i}" for i in random.integers(0, 65, 4)) for _ in range(20)] + ["", "absent", "w0 w0 w1"]
    wi.build_index(texts(spark, contents).repartition(3), str(tmp_path / "i"), block)
    got, want = best(spark, str(tmp_path / "i"), contents, queries, 6)
    assert got == want
    got, want = best(spark, str(tmp_path / "i"), contents, queries[:3], 1000)  # more than there is
    assert got == want


def test_negative_weights(spark, tmp_path):
    contents = ["same words", "same words", "same words", "same words", "", "same", ""] + ["same words"] * 30 + [""]
    wi.build_index(texts(spark, contents), str(tmp_path / "i"), 4)
    for k in (1, 3, 10):
        got, want = best(spark, str(tmp_path / "i"), contents, ["same", "words absent", "none", "same words same"], k)
        assert got == want


def test_small_texts(spark, tmp_path):
    wi.build_index(texts(spark, CONTENTS), str(tmp_path / "i"))
    got, want = best(spark, str(tmp_path / "i"), CONTENTS, QUERIES, 4)
    assert got == want


def test_a_search_decodes_few_postings(spark, tmp_path):
    """A rare word decides, so most blocks of a common one cannot hold a result."""
    random = np.random.default_rng(0)
    contents = ["common " * int(random.integers(1, 4)) + "filler " * int(random.integers(0, 9)) for _ in range(6000)]
    for i in range(40, 46):
        contents[i] += " rare rare"
    path = str(tmp_path / "i")
    wi.build_index(texts(spark, contents).coalesce(1), path, 64)
    queries = ["rare common"] + ["rare"] * 3
    cost = wi.search_cost(spark, path, asked(spark, queries), 3).first()
    assert cost["total"] >= 6000 and cost["decoded"] < 0.2 * cost["total"]
    got, want = best(spark, path, contents, queries, 3)
    assert got == want


def test_adding_and_removing_equals_a_rebuild(spark, tmp_path):
    contents = corpus(4, 500)
    queries = ["w0 w3 w9", "w1", "w30 w41 w2", "absent", "w0 w1"]
    path = str(tmp_path / "i")
    wi.build_index(texts(spark, contents[:300]), path, 16)
    wi.add_documents(texts(spark, contents[300:], range(300, 500)), path, 16)
    got, want = best(spark, path, contents, queries, 5)
    assert got == want
    gone = [*range(0, 500, 3), 1, 2, 490]
    for part in (gone[:50], gone[50:], gone[:5]):
        wi.remove_documents(spark, path, spark.createDataFrame([(i,) for i in part], "id long"))
    left = [i for i in range(500) if i not in set(gone)]
    want = [(q, r, left[i], s) for q, r, i, s in brute_force([contents[i] for i in left], queries, 5)]
    assert rows(wi.search_index(spark, path, asked(spark, queries), 5)) == want
    back = gone[:7]
    wi.add_documents(texts(spark, [contents[i] for i in back], back), path, 16)
    left = sorted([*left, *back])
    want = [(q, r, left[i], s) for q, r, i, s in brute_force([contents[i] for i in left], queries, 5)]
    assert rows(wi.search_index(spark, path, asked(spark, queries), 5)) == want
    version, content = snapshots.latest(spark, path)
    assert version == 5 and len(content["segments"]) == 3  # what is gone already makes no version


def test_string_ids_empty_index_and_no_queries(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", None), ("d", "")], "id string, content string")
    wi.build_index(docs, str(tmp_path / "i"))
    assert [(r["rank"], r["id"]) for r in wi.search_index(spark, str(tmp_path / "i"), asked(spark, ["x"]), 3).orderBy("rank").collect()][:2] == [(1, "a"), (2, "b")]
    assert wi.search_index(spark, str(tmp_path / "i"), asked(spark, [])).count() == 0
    wi.build_index(docs.limit(0), str(tmp_path / "none"))
    assert wi.search_index(spark, str(tmp_path / "none"), asked(spark, ["x"])).count() == 0
    with pytest.raises(snapshots.Conflict):
        wi.build_index(docs, str(tmp_path / "i"))


def test_index_is_smaller_than_rows(spark, tmp_path):
    contents = corpus(9, 2000, 30)
    path = str(tmp_path / "i")
    wi.build_index(texts(spark, contents).coalesce(1), path)
    content = snapshots.latest(spark, path)[1]
    blocks = wi._rows(spark, path, content["segments"][0], "blocks").collect()
    size = sum(len(b["places"]) + len(b["counts"]) + len(b["lengths"]) for b in blocks)
    assert size < 6 * sum(b["n"] for b in blocks)  # bytes a posting


def test_first_absent():
    random = np.random.default_rng(0)
    for _ in range(300):
        n, k = int(random.integers(0, 30)), int(random.integers(1, 8))
        taken = np.flatnonzero(random.random(n) < random.random())
        want = [i for i in range(n) if i not in taken][:k]
        assert sc.first_absent(taken, n, k).tolist() == want


def test_packing():
    for x in ([], [0], [255], [256, 0], [70000], [1 << 40, 3]):
        assert sc.unpack(sc.pack(np.array(x, dtype=np.int64))).tolist() == x


class _Counted(dict):
    looks = 0

    def __getitem__(self, key):
        _Counted.looks += 1
        return super().__getitem__(key)


def test_scoring_looks_at_a_block_a_few_times():
    """Work grows with the blocks of a search, not with blocks times the stretches between their borders."""
    blocks = []
    for w in range(3):
        for i in range(1000):
            place = np.array([4 * i + w])
            blocks.append(_Counted(token=f"w{w}", block=i, n=1, first=int(place[0]), last=int(place[0]), most=1, least=5, places=sc.pack(place * 0), counts=sc.pack(place * 0 + 1), lengths=sc.pack(place * 0 + 5)))
    _Counted.looks = 0
    place, score = sc.Shard(blocks, np.zeros(0, np.int64), 4000, 5.0).scored([(f"w{w}", 1.0, 1) for w in range(3)], 4)
    assert place.tolist() == [0, 1, 2, 4] and len(set(score.tolist())) == 1
    assert _Counted.looks < 30 * len(blocks)


def test_packing_many_runs():
    random = np.random.default_rng(1)
    for top in (3, 300, 70_000, 1 << 40):
        x = random.integers(0, top, 60)
        x[:20] = random.integers(0, 200, 20)
        starts = np.array([0, 1, 20, 33, 60])
        assert sc.pack_runs(x, starts).to_pylist() == [sc.pack(x[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def test_lost_postings_of_many_blocks(monkeypatch):
    """As counted block by block; a bitmap is opened once for many blocks, not once for each."""
    import pyarrow as pa

    random = np.random.default_rng(2)
    monkeypatch.setattr(wi, "LOST_BLOCKS", 100)
    gone = [np.sort(random.choice(n, n // 3, replace=False)) for n in (40, 900, 70_000)]
    maps = [wi._as_bitmap(pa.table({"shard": [i] * len(g), "first": g})).column("gone")[0].as_py() for i, g in enumerate(gone)]
    rows, want = [], []
    for t in range(350):
        shard = int(random.integers(3))
        place = np.unique(random.integers(0, (60, 1000, 90_000)[shard], int(random.integers(1, 6))))
        rows.append({"token": f"t{t}", "first": int(place[0]), "places": sc.pack(np.diff(place, prepend=place[0])), "gone": maps[shard]})
        want.append((f"t{t}", int(np.isin(place, gone[shard]).sum())))
    schema = pa.schema([("token", pa.string()), ("first", pa.int32()), ("places", pa.binary()), ("gone", pa.binary())])
    opened = []
    monkeypatch.setattr(wi.np, "unpackbits", lambda *a, f=np.unpackbits, **b: opened.append(1) or f(*a, **b))
    monkeypatch.setattr(sc.np, "unpackbits", wi.np.unpackbits)
    got = [(r["token"], r["df"]) for b in wi._lost_words(iter([pa.RecordBatch.from_pylist(rows, schema=schema).slice(0, 350)])) for r in b.to_pylist()]
    assert got == want and len(opened) <= 12


def counted(contents, part=0):
    """Batches as a task of a build gets them."""
    import pyarrow as pa

    tokens = [None if c is None else c.split() for c in contents]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(tokens))), pa.array(tokens, pa.list_(pa.string()))], names=["id", "tokens"])
    for b in sc.packed_batches(sc.counted_batches(iter([batch]))):
        yield b.append_column("part", pa.array([part] * b.num_rows, pa.int32()))


def test_words_of_documents_packed():
    contents = ["", "b a b", None, "é " * 300 + "z", "x\x00y \U0001f600", ""] * 2
    for start, stop in ((0, 12), (2, 3), (3, 9)):
        for batch in counted(contents):
            words, counts = sc.unpacked_words(batch.slice(start, stop - start))
            want = [sorted({w: c.split().count(w) for w in c.split()}.items()) for c in contents[start:stop] if c]
            n = [x for x in batch.column("n").to_pylist()[start:stop] if x]
            got = list(zip(words.to_pylist(), counts.tolist()))
            assert [sorted(got[a - k : a]) for a, k in zip(np.cumsum(n).tolist(), n)] == want


def test_shards_cut_in_pieces(monkeypatch):
    """Whatever is held, cut and handed on at once, each shard has all postings of its documents, by word and place."""
    contents = [*corpus(6, 300), None, "", "w1 " * 70_000]
    for c, v in (("SHARD_POSTINGS", 700), ("PIECE_DOCS", 37), ("CUT_POSTINGS", 50), ("OUT_ROWS", 9)):
        monkeypatch.setattr(wi, c, v)
    rows = [r for b in wi._inverted_batches(counted(contents, 3), 8) for r in b.to_pylist()]
    docs = [r for r in rows if r["token"] is None]
    shards = sorted({r["shard"] for r in docs})
    assert len(shards) > 3 and shards == [(3 << 32) + i for i in range(len(shards))]
    assert [(r["id"], r["n"]) for r in docs] == [(i, len((c or "").split())) for i, c in enumerate(contents)]
    for shard in shards:
        mine = [r for r in docs if r["shard"] == shard]
        assert [r["first"] for r in mine] == list(range(len(mine)))
        want = sorted((w, r["first"], (contents[r["id"]] or "").split().count(w), r["n"]) for r in mine for w in set((contents[r["id"]] or "").split()))
        got = []
        for r in (r for r in rows if r["shard"] == shard and r["token"] is not None):
            place = r["first"] + np.cumsum(sc.unpack(r["places"]))
            counts, lengths = sc.unpack(r["counts"]), sc.unpack(r["lengths"])
            assert len(place) == r["n"] <= 8 and (r["first"], r["last"], r["most"], r["least"]) == (place[0], place[-1], counts.max(), lengths.min())
            got += zip([r["token"]] * len(place), place.tolist(), counts.tolist(), lengths.tolist())
        assert got == want


def test_building_a_shard_holds_few_bytes_a_posting(monkeypatch):
    """Arrays of a shard grow with its postings, so what is cut into blocks at once is little; all at once took 97 bytes a posting."""
    import tracemalloc

    monkeypatch.setattr(wi, "CUT_POSTINGS", 1 << 13)
    random = np.random.default_rng(3)
    contents = [" ".join(f"w{i}" for i in (random.zipf(1.3, 300) % 100_000).tolist()) for _ in range(3000)]
    batches = list(counted(contents))
    postings = sum(int(np.sum(np.asarray(b.column("n")))) for b in batches)
    tracemalloc.start()
    made = sum(b.num_rows for b in wi._inverted_batches(iter(batches), 512))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 3000 and held < 40 * postings


def test_rows_are_not_sorted_by_kind_before_they_are_written(spark, tmp_path):
    """One table for both kinds; segments from before, with a folder for either, are read as well."""
    contents, path = corpus(8, 200), str(tmp_path / "i")
    wi.build_index(texts(spark, contents), path, 16)
    segment = snapshots.latest(spark, path)[1]["segments"][0]
    rows_at = tmp_path / "i" / "segments" / segment["name"] / "rows"
    assert not list(rows_at.glob("kind=*"))
    before = spark.read.parquet(str(rows_at))
    before.selectExpr("*", "if(token IS NULL, 'docs', 'blocks') AS kind").write.partitionBy("kind").parquet(str(tmp_path / "old" / "segments" / segment["name"] / "rows"))
    spark.read.parquet(f"{path}/segments/{segment['name']}/terms").write.parquet(str(tmp_path / "old" / "segments" / segment["name"] / "terms"))
    snapshots.publish(spark, str(tmp_path / "old"), 0, {"segments": [segment]})
    for at in (path, str(tmp_path / "old")):
        got, want = best(spark, at, contents, ["w0 w3", "w1", "absent"], 5)
        assert got == want
