import glob
import json

import pytest
from pyspark.sql import functions as F

from docwarden.operators.search import DocumentIndex
from docwarden.plans import jobs
from docwarden.streaming.continuous import audit_stream
from tests.helpers import BARE, BROKEN, CLEAN, PARTIAL, RULES, docs_of


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "prompts"
    root.mkdir()
    for name, text in {"clean.md": CLEAN, "broken.md": BROKEN, "partial.md": PARTIAL, "bare.md": BARE}.items():
        (root / name).write_text(text)
    return root


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f, encoding="utf-8").read().split("\n")[:-1]]


def records(path):
    return [json.loads(x) for x in lines(path)]


def test_scan_to_plan(spark, folder, tmp_path):
    out = tmp_path / "out"
    scan = jobs.run_scan(spark, [str(folder), "/nonexistent"], {"owner/gone": None}, output_path=str(out / "scan"))
    assert [(r["type"], r["label"], r["error"]) for r in scan.sources.collect()] == [("local", "prompts", None), ("remote", "owner/gone", "clone_failed")]
    assert len(records(out / "scan" / "candidates")) == 4 and records(out / "scan" / "manifest")[0]["dry_run"] is True
    audit = jobs.run_audit(scan, output_path=str(out / "audit"), report_md_path=str(out / "audit-md"))
    report = records(out / "audit" / "report")[0]
    assert report["summary"]["total_findings"] == 16 and report["rule_source"]["rule_count"] == 10
    files = {r["path"]: r for r in records(out / "audit" / "files")}
    assert files["clean.md"]["finding_count"] == 0 and [f["rule_id"] for f in files["bare.md"]["findings"]] == ["FM001", "CT002"]
    text = lines(out / "audit-md")
    assert text[0] == "# Audit Report" and "| 4 | 16 | 4 | 5 | 7 |" in text
    titles = [x for x in text if x.startswith("### ")]
    assert titles == ["### `prompts/bare.md`", "### `prompts/broken.md`", "### `prompts/partial.md`"]
    plan = jobs.run_plan(audit, output_path=str(out / "plan"), report_md_path=str(out / "plan-md"))
    assert len(records(out / "plan" / "items")) == 16
    text = lines(out / "plan-md")
    assert text[:2] == ["# Improvement Plan", ""] and text[-1] == ""
    at = text.index("| Severity | Count |")
    assert text[at + 2 : at + 5] == ["| error | 4 |", "| warning | 5 |", "| info | 7 |"]
    assert text[-17].startswith("| 1 | `prompts/bare.md` | `FM001` | error | low | low | ✅ |") and text[-2].startswith("| 16 |")
    assert {(r["dimension"], r["key"]): r["n"] for r in plan.summary().collect()}[("total", None)] == 16


def test_file_list(spark, folder):
    audit = jobs.run_audit([str(folder / "bare.md"), str(folder / "gone.md")], RULES, spark=spark)
    assert [(r["path"], r["finding_count"]) for r in audit.files().collect()] == [("bare.md", 2)]


def test_texts_that_are_gone_count_as_empty(spark):
    docs = docs_of(spark, [CLEAN, BARE])
    audit = jobs.run_audit(jobs.audit_manifest(docs, docs.where("path = 'd000.md'")), RULES)
    counts = {r["path"]: sorted(f["rule_id"] for f in r["findings"]) for r in audit.files().collect()}
    assert counts == {"d000.md": [], "d001.md": ["CT001", "CT002", "FM001", "ST001"]}


def test_fix_dry_and_in_place(spark, folder, tmp_path):
    audit = jobs.run_audit(jobs.run_scan(spark, [str(folder)]), RULES)
    plan = jobs.run_plan(audit)
    dry = jobs.run_fix(audit, plan.items)
    assert dry.actions.count() == 5 and not dry.applied and (folder / "bare.md").read_text() == BARE
    assert dry.summary().first()["files_audited"] == 3
    half = jobs.run_fix(audit, apply=True, dry_run=True, in_place=True)
    assert not half.applied and (folder / "bare.md").read_text() == BARE
    done = jobs.run_fix(audit, apply=True, dry_run=False, in_place=True, output_path=str(tmp_path / "fixed"))
    assert (folder / "bare.md").read_text().startswith('---\nid: "plain-notes-without-a-block"\n')
    assert (folder / "clean.md").read_text() == CLEAN
    assert done.applied and all(r["applied"] for r in done.actions.collect())
    delta = {r["rule_id"]: (r["before"], r["after"]) for r in done.delta().collect()}
    assert delta["FM001"] == (1, 0)
    assert spark.read.parquet(str(tmp_path / "fixed")).count() == 3
    again = jobs.run_audit(jobs.run_scan(spark, [str(folder)]), RULES)
    assert again.findings().where("rule_id = 'FM001'").count() == 0


def test_migrate(spark, folder, tmp_path):
    scan = jobs.run_scan(spark, [str(folder)])
    dry = jobs.run_migrate(scan, skills_root=str(tmp_path / "lib" / "skills"))
    assert dry.summary().first().asDict() == {"total": 4, "applied": 0, "pointers_written": 0, "deleted": 0}
    assert not (tmp_path / "lib").exists()
    options = dict(skills_root=str(tmp_path / "lib" / "skills"), apply=True, dry_run=False, in_place=True, migrated_at="NOW")
    jobs.run_migrate(scan, **options, output_path=str(tmp_path / "tables"))
    moved = (tmp_path / "lib" / "skills" / "logs" / "log-reader.md").read_text()
    assert moved.startswith("---\nid: log-reader\n") and "source: https://github.com/prompts\nmigrated_at: NOW\n---\n# Log Reader" in moved
    assert "has been migrated" in (folder / "clean.md").read_text()
    assert spark.read.parquet(str(tmp_path / "tables" / "skills")).count() == 4
    assert spark.read.parquet(str(tmp_path / "tables" / "pointers")).count() == 4


def test_migrate_and_delete(spark, folder, tmp_path):
    scan = jobs.run_scan(spark, [str(folder)])
    jobs.run_migrate(scan, skills_root=str(tmp_path / "lib" / "skills"), apply=True, dry_run=False, in_place=True, allow_delete=True, write_pointer=False)
    assert list(folder.iterdir()) == [] and (tmp_path / "lib" / "skills" / "general" / "half-done.md").exists()


def test_migrate_keeps_sources_whose_copy_failed(spark, folder, tmp_path):
    """A file stands where a destination folder belongs."""
    lib = tmp_path / "lib" / "skills"
    lib.mkdir(parents=True)
    (lib / "general").write_text("in the way")
    before = {p.name: p.read_bytes() for p in folder.iterdir()}
    for options in ({"allow_delete": True, "write_pointer": False}, {"write_pointer": True}):
        scan = jobs.run_scan(spark, [str(folder)])
        moved = jobs.run_migrate(scan, skills_root=str(lib), apply=True, dry_run=False, in_place=True, **options)
        rows = {r["path"]: r for r in moved.actions.collect()}
        failed = [r["path"] for r in rows.values() if r["domain"] == "general"]
        assert failed and all((folder / p).read_bytes() == before[p] for p in failed)
        assert not any(rows[p][f] for p in failed for f in ("applied", "deleted_source", "wrote_pointer"))
        summary = moved.summary().first()
        assert summary["total"] == len(rows) and summary["applied"] == sum(r["applied"] for r in rows.values())


def test_scan_sees_one_content(spark, folder):
    scan = jobs.run_scan(spark, [str(folder)])
    before = jobs.run_audit(scan).summary().collect()
    for p in folder.iterdir():
        p.write_text("You are changed. Act as another.")
    assert jobs.run_audit(scan).summary().collect() == before


def test_search(spark):
    docs = docs_of(spark, [CLEAN, BARE]).withColumn("id", F.col("path"))
    found = jobs.run_search(DocumentIndex(docs), spark.createDataFrame([(1, "server logs")], "qid long, text string"), 1)
    assert found.first()["id"] == "d000.md"


def test_arriving_documents(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "findings")
    docs = docs_of(spark, [CLEAN, BARE, PARTIAL])
    docs.where("path < 'd002'").write.parquet(str(inbox))
    stream = spark.readStream.schema(docs.schema).parquet(str(inbox))
    audit_stream(stream, RULES, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    docs.where("path = 'd002.md'").write.mode("append").parquet(str(inbox))
    audit_stream(stream, RULES, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).groupBy("path").count().orderBy("path").collect() == [("d001.md", 2), ("d002.md", 6)]
