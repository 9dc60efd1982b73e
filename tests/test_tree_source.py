import json
import shutil

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from docwarden.sources import corpus, tree
from docwarden.sources.tree import TreeReader, read_tree, suffix


@pytest.fixture
def root(tmp_path):
    for name in ["a.md", "b.TXT", ".hid/x.md", "x/y/z/deep.md", "x/y/z/big.md", "x/.git/no.md", "build/no.md", "w/one.md", "w/two.prompt", "w/_three.md", "w/pic.png", "w/v/u.md", "noext", ".md"]:
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name * (1000 if "big" in name else 1))
    return tmp_path / "root"


KEPT = [".hid/x.md", ".md", "a.md", "b.TXT", "noext", "w/_three.md", "w/one.md", "w/pic.png", "w/two.prompt", "w/v/u.md", "x/y/z/big.md", "x/y/z/deep.md"]


def reader(root, **options):
    return TreeReader({"roots": json.dumps([["r", str(root)]]), **{k: str(v) for k, v in options.items()}})


def paths(r):
    return sorted(p for chunk in r.partitions() for b in r.read(chunk) for p in b.column("path").to_pylist())


@pytest.mark.parametrize("chunks", [1, 2, 3, 5, 50])
def test_each_file_is_in_one_partition(root, chunks):
    assert paths(reader(root, chunks=chunks)) == KEPT


def test_a_single_full_folder_is_shared_by_tasks(tmp_path):
    for i in range(200):
        (tmp_path / f"f{i}.md").write_text("x")
    r = reader(tmp_path, chunks=8)
    sizes = [sum(b.num_rows for b in r.read(c)) for c in r.partitions()]
    assert len(sizes) == 8 and sum(sizes) == 200 and max(sizes) < 50


def test_folders_outside_a_prefix_are_not_entered(root, monkeypatch):
    entered = []
    whole = tree.entries
    monkeypatch.setattr(tree, "entries", lambda f: entered.append(f) or whole(f))
    for chunks in (1, 20):
        r = reader(root, chunks=chunks)
        left = list(r.pushFilters([ds.StringStartsWith(("path",), "x/y"), ds.StringContains(("path",), "e")]))
        assert [type(f) for f in left] == [ds.StringContains]
        assert paths(r) == ["x/y/z/big.md", "x/y/z/deep.md"]
    assert not any("/w" in f[len(str(root)) :] or ".hid" in f for f in entered)


def test_no_dropped_file_is_opened(root, monkeypatch):
    opened = []
    whole = tree.read_bytes
    monkeypatch.setattr(tree, "read_bytes", lambda f: opened.append(f) or whole(f))
    r = reader(root)
    assert list(r.pushFilters([ds.In(("suffix",), (".md",)), ds.GreaterThan(("size_bytes",), 1000), ds.IsNotNull(("suffix",))])) == []
    assert paths(r) == ["x/y/z/big.md"] and len(opened) == 1


def test_filters_reach_the_source_and_give_the_same_rows(spark, root, capsys):
    roots = [("r", str(root)), ("other", str(root / "w"))]
    df = read_tree(spark, roots)
    tests = [
        F.col("suffix").isin(".md", ".txt"),
        F.col("repo") == "other",
        F.col("path").startswith("w/"),
        F.col("path").endswith("p.md") & (F.col("size_bytes") < 100),
        (F.col("path") == "a.md") | (F.col("suffix") == ".prompt"),
        F.col("path").isin("x/y/z/deep.md", "a.md"),
        ~F.col("path").startswith("w"),
        F.col("path").contains("v/"),
    ]
    everything = {(r["repo"], r["path"], r["size_bytes"], bytes(r["content"])) for r in df.collect()}
    assert len(everything) == len(KEPT) + 5
    local = spark.createDataFrame([(repo, p, suffix(p.rsplit("/", 1)[-1]), n, c) for repo, p, n, c in everything], "repo string, path string, suffix string, size_bytes long, content binary")
    for t in tests:
        key = ["repo", "path"]
        want = sorted(map(tuple, local.where(t).select(*key).collect()))
        some = read_tree(spark, roots, t)
        assert sorted(map(tuple, some.select(*key).collect())) == want
        # One frame used with several filters, alone and in one query.
        assert sorted(map(tuple, df.where(t).select(*key).collect())) == want
        assert some.where("suffix = '.md'").unionByName(some.where("suffix <> '.md'")).count() == len(want)
    assert df.count() == len(everything)
    capsys.readouterr()
    corpus.scan_tree(spark.createDataFrame([("r", str(root))], "repo string, root string"), F.col("path").startswith("w/")).explain("formatted")
    plan = capsys.readouterr().out
    scan = plan[plan.rindex("BatchScan") :]
    assert "PushedFilters" in scan and "suffix" in scan and "w/" in scan


def test_nothing_is_listed_before_an_action(spark, tmp_path):
    (tmp_path / "late").mkdir()
    (tmp_path / "late" / "a.md").write_text("first")
    docs = corpus.scan_tree(spark.createDataFrame([("r", str(tmp_path / "late"))], "repo string, root string"))
    (tmp_path / "late" / "a.md").write_text("second")
    (tmp_path / "late" / "b.md").write_text("third")
    assert sorted(r["content"] for r in docs.collect()) == ["second", "third"]
    shutil.rmtree(tmp_path / "late")
    assert docs.count() == 0


def test_names_without_contents(spark, root):
    rows = read_tree(spark, [("r", str(root))], content=False).collect()
    assert sorted(r["path"] for r in rows) == KEPT
    assert all(r["content"] is None for r in rows) and {r["path"]: r["size_bytes"] for r in rows}["x/y/z/big.md"] == 12000


def test_suffixes():
    assert [suffix(n) for n in ("a.MD", ".md", "a.", "a.b.c", "a", ".x.y")] == [".md", "", "", ".c", "", ".y"]
