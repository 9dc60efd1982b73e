import pytest
import os

from pyspark.sql import functions as F

from docwarden.operators import candidates as cd
from docwarden.sources import corpus, writers
from tests.helpers import BARE, CLEAN, docs_of


def tree(root):
    files = {
        "prompts/a.md": CLEAN,
        ".github/prompts/hidden.md": BARE,
        ".dot.md": BARE,
        "node_modules/p/prompt.md": "x",
        "deep/er/build/skill.md": "x",
        "deep/er/still/skill.MD": "line\r\nline\r",
        "img/prompt.png": "x",
        "plain.md": "nothing",
        "empty-prompt.txt": "",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "prompts" / "bad.md").write_bytes(b"caf\xe9")
    (root / "linked").symlink_to(root / "prompts", target_is_directory=True)
    (root / "link.md").symlink_to(root / "prompts" / "a.md")
    (root / "dangling.md").symlink_to(root / "nowhere")
    (root / "void").mkdir()


def test_tree(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    tree(root)
    roots = spark.createDataFrame([("mine", str(root)), ("mine2", str(root / "void")), ("mine3", str(root / "missing"))], "repo string, root string")
    rows = {r["path"]: r for r in corpus.scan_tree(roots).collect()}
    assert sorted(rows) == [".dot.md", ".github/prompts/hidden.md", "deep/er/still/skill.MD", "empty-prompt.txt", "link.md", "plain.md", "prompts/a.md", "prompts/bad.md"]
    assert rows["prompts/bad.md"]["content"] == "caf�" and rows["prompts/bad.md"]["size_bytes"] == 4
    assert rows["deep/er/still/skill.MD"]["content"] == "line\nline\n" and rows["deep/er/still/skill.MD"]["size_bytes"] == 11
    assert rows["prompts/a.md"]["abs_path"] == str(root / "prompts/a.md") and rows["prompts/a.md"]["repo"] == "mine"
    found = cd.candidates(corpus.scan_tree(roots), "relative")
    assert sorted(r["path"] for r in found.collect()) == [".github/prompts/hidden.md", "deep/er/still/skill.MD", "empty-prompt.txt", "prompts/a.md", "prompts/bad.md"]


def test_parents_of_the_root_count(spark, tmp_path):
    root = tmp_path / "my-skills"
    root.mkdir()
    (root / "note.md").write_text("nothing special")
    docs = corpus.scan_tree(spark.createDataFrame([("r", str(root))], "repo string, root string"))
    assert cd.candidates(docs).count() == 1 and cd.candidates(docs, "relative").count() == 0


def test_no_roots(spark):
    assert corpus.scan_tree(spark.createDataFrame([], "repo string, root string")).count() == 0


def test_file_list(spark, tmp_path):
    (tmp_path / "a.md").write_text("text")
    paths = spark.createDataFrame([(str(tmp_path / "a.md"),), (str(tmp_path / "gone.md"),)], "path string")
    rows = corpus.scan_files(paths).collect()
    assert [(r["repo"], r["path"], r["abs_path"], r["content"]) for r in rows] == [(str(tmp_path), "a.md", str(tmp_path / "a.md"), "text")]


def test_object_store(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "with blank").mkdir()
    (tmp_path / "with blank" / ".My #1 Skill?.md").write_text("hidden file")
    docs = corpus.scan_object_store(spark, "r", f"file://{tmp_path}")
    rows = {r["path"]: r for r in docs.collect()}
    assert rows["with blank/.My #1 Skill?.md"]["content"] == "hidden file"
    assert ".github/prompts/hidden.md" in rows and rows["prompts/a.md"]["abs_path"] == f"{tmp_path}/prompts/a.md"
    assert "prompts/a.md" in [r["path"] for r in cd.candidates(docs, "relative").collect()]


def test_names_are_cut_from_the_full_address(spark):
    raw = spark.createDataFrame([("s3a://bucket/root/a b.md", b"x", 1), ("s3a://bucket/root/.git/c.md", b"x", 1), ("s3a://bucket/root/p.png", b"x", 1)], "path string, content binary, length long")
    rows = corpus.named_below(raw, "r", "s3a://bucket/root").collect()
    assert [(r["path"], r["abs_path"]) for r in rows] == [("a b.md", "s3a://bucket/root/a b.md")]
    raw = spark.createDataFrame([("hdfs://nn:8020/data/x/a.md", b"x", 1)], "path string, content binary, length long")
    assert corpus.named_below(raw, "r", "hdfs://nn:8020/data/x").first()["path"] == "a.md"


def test_addresses_are_split_at_the_host():
    assert corpus.split_address("s3a://bucket/a b/#c.md") == ("s3a://bucket", "/a b/#c.md")
    assert corpus.split_address("file:///x/My Skill?.md") == ("", "/x/My Skill?.md")
    assert corpus.split_address("/x/a://b.md") == ("", "/x/a://b.md")


def test_odd_names_in_trees_and_lists(spark, tmp_path):
    names = ["My Skill.md", "a#b.md", "q?x=1.md", "100%.md"]
    for n in names:
        (tmp_path / n).write_text("text " + n)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        docs = corpus.scan_tree(spark.createDataFrame([("r", root)], "repo string, root string")).collect()
        assert {r["path"]: r["content"] for r in docs} == {n: "text " + n for n in names}
        paths = spark.createDataFrame([(f"{root}/{n}",) for n in names], "path string")
        assert sorted(r["path"] for r in corpus.scan_files(paths).collect()) == sorted(names)


def test_only_files_out_of_reach_are_skipped(spark, tmp_path, monkeypatch):
    assert corpus.read_bytes(str(tmp_path / "gone.md")) is None
    with pytest.raises(OSError):
        corpus.read_bytes(str(tmp_path))


def test_a_write_is_whole_or_not_at_all(tmp_path):
    corpus.write_bytes(str(tmp_path / "new" / "a.md"), b"1")
    corpus.write_bytes(str(tmp_path / "new" / "a.md"), b"22")
    assert [p.read_bytes() for p in (tmp_path / "new").iterdir()] == [b"22"]
    (tmp_path / "file").write_text("x")
    with pytest.raises(OSError):
        corpus.write_bytes(str(tmp_path / "file" / "a.md"), b"1")


def test_sources_with_one_label_are_counted_apart(spark):
    roots = spark.createDataFrame([("k1", "lib"), ("k2", "lib"), ("k3", "x")], "key string, label string")
    found = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "source string")
    rows = corpus.sources_table(roots, found, "key", "source").collect()
    assert {r["key"]: r["n_candidates"] for r in rows} == {"k1": 1, "k2": 2, "k3": 0}


def test_manifest_entries(spark):
    entries = {r["path"]: r for r in cd.describe(docs_of(spark, [CLEAN, BARE, "---\n[]\n---\n", "---\n- 1\n---\n"])).collect()}
    assert [entries[f"d{i:03d}.md"]["has_frontmatter"] for i in range(4)] == [True, False, True, True]
    assert [entries[f"d{i:03d}.md"]["frontmatter"] for i in range(1, 4)] == ["{}", "{}", "[1]"]
    assert '"min_context_tokens": 2048' in entries["d000.md"]["frontmatter"]


def test_sources_table(spark):
    roots = spark.createDataFrame([("local", "a"), ("remote", "b")], "type string, label string")
    rows = {r["label"]: r["n_candidates"] for r in corpus.sources_table(roots, docs_of(spark, [CLEAN, BARE], "a")).collect()}
    assert rows == {"a": 2, "b": 0}


def test_written_files(spark, tmp_path):
    docs = docs_of(spark, ["é", "b"]).withColumn("abs_path", F.concat(F.lit(f"{tmp_path}/new/"), "path"))
    assert all(r["done"] for r in writers.write_files(docs).collect())
    assert (tmp_path / "new" / "d000.md").read_bytes() == "é".encode()
    assert all(r["done"] for r in writers.delete_files(docs).collect())
    assert not os.listdir(tmp_path / "new")
    # A task that is repeated finds its files gone, as it should.
    assert all(r["done"] for r in writers.delete_files(docs).collect())


def test_domain_folders(spark, tmp_path):
    docs = docs_of(spark, ["a", "b", "c"]).withColumn("domain", F.when(F.col("path") < "d002", "one").otherwise("two"))
    stored = writers.write_by_domain(docs, str(tmp_path / "out"))
    assert stored.count() == 3 and {d for d in os.listdir(tmp_path / "out") if "=" in d} == {"domain=one", "domain=two"}


def test_a_failure_that_may_pass_fails_the_task(spark, tmp_path, monkeypatch):
    import errno

    import pandas as pd

    frame = pd.DataFrame({"path": ["p"], "key": ["k"], "address": [str(tmp_path / "f.md")], "content": ["x"]})
    for code, final in ((errno.ETIMEDOUT, False), (errno.EIO, False), (errno.EACCES, True), (errno.EISDIR, True)):

        def broken(*_, code=code):
            raise OSError(code, "failed")

        monkeypatch.setattr(writers, "write_bytes", broken)
        monkeypatch.setattr(writers, "delete_file", broken)
        for run, rows in ((writers._write, frame), (writers._delete, frame.drop(columns="content"))):
            if final:
                assert next(run(iter([rows])))["done"].tolist() == [False]
            else:
                with pytest.raises(OSError, match="failed"):
                    next(run(iter([rows])))


def test_a_folder_in_the_way_is_final(spark, tmp_path):
    (tmp_path / "a.md").mkdir()
    (tmp_path / "a.md" / "x").write_text("x")
    docs = spark.createDataFrame([(str(tmp_path / "a.md"), "text"), (str(tmp_path / "b.md"), "text")], "abs_path string, content string")
    assert sorted((r["path"][-4:], r["done"]) for r in writers.write_files(docs).collect()) == [("a.md", False), ("b.md", True)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "b.md"]


def test_files_are_written_in_pieces_and_folders_made_once(tmp_path, monkeypatch):
    import pyarrow as pa

    from docwarden.sources import files

    n, sizes, made = 1000, [], []
    address = [str(tmp_path / "deep" / f"{i}.md") for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"path": address, "key": pa.nulls(n, pa.string()), "address": address, "content": [f"text {i} ä" for i in range(n)]})

    def watched(frames):
        return writers._write(sizes.append(len(f)) or f for f in frames)

    makedirs = os.makedirs
    monkeypatch.setattr(files.os, "makedirs", lambda *a, **b: made.append(a) or makedirs(*a, **b))
    done = list(writers._in_pieces(watched)(iter([batch])))
    assert all(all(d.column("done").to_pylist()) for d in done) and sum(d.num_rows for d in done) == n
    assert max(sizes) <= 256 and len(made) == 1
    assert {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "deep").iterdir()} == {f"{i}.md": f"text {i} ä" for i in range(n)}


def test_read_pieces_are_of_bounded_size(tmp_path):
    import pyarrow as pa

    for i in range(12):
        (tmp_path / f"{i}.md").write_bytes(bytes([65 + i]) * (3 << 20))
    address = [str(tmp_path / f"{i}.md") for i in range(13)]  # the last one is gone
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 13, "path": address, "abs_path": address, "address": address})
    pieces = list(corpus._read_files(iter([batch])))
    assert max(p.nbytes for p in pieces) < 16 << 20
    assert [(r["path"], r["content"] and (len(r["content"]), r["content"][:1])) for p in pieces for r in p.to_pylist()] == [(a, (3 << 20, bytes([65 + i])) if i < 12 else None) for i, a in enumerate(address)]
