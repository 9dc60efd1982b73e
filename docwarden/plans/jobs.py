"""The six user-level jobs: scan, audit, plan, fix, migrate and search.

Each takes and gives frames; nothing is written unless a path (or ``apply``) asks for it.
"""

from __future__ import annotations

import datetime
import logging
import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions.frontmatter import with_frontmatter
from docwarden.functions import text as tx
from docwarden.functions.shaping import filter_once
from docwarden.operators import audit as au
from docwarden.operators import candidates as cd
from docwarden.operators import fix as fx
from docwarden.operators import migrate as mg
from docwarden.operators import plan as pl
from docwarden.operators.rules import RuleSet
from docwarden.operators.search import DEFAULT_TOP_K, DocumentIndex
from docwarden.scratch import materialise
from docwarden.sources import corpus, reports, writers
from docwarden.sources.rule_files import fetch_rules

logger = logging.getLogger(__name__)

SOURCE_DDL = "type string, path string, url string, label string, commit_sha string, error string"


def utc_now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat().replace("+00:00", "Z")


@dataclass(frozen=True)
class Scan:
    sources: DataFrame
    candidates: DataFrame
    created_at: str

    def manifest(self) -> DataFrame:
        return cd.describe(self.candidates)


def describe_sources(specs: DataFrame) -> DataFrame:
    """``specs(spec)`` of repositories with ``url`` and ``label``."""
    return specs.select("spec", tx.repo_url(F.col("spec")).alias("url"), tx.source_label(F.col("spec")).alias("label"))


def run_scan(
    spark: SparkSession,
    local_paths: list[str] | None = None,
    repos: dict[str, str | tuple[str, str] | None] | None = None,
    output_path: str | None = None,
    dry_run: bool = True,
    path_scope: str = "absolute",
    created_at: str | None = None,
) -> Scan:
    """Candidate documents below the given folders.

    ``repos`` maps a repository (``owner/name`` or address) to the folder of its checkout, or to
    ``(folder, commit_sha)``; None stands for a checkout that failed.  Candidates are written once, so later steps
    see one content even if the files change.
    """
    stamp = created_at or utc_now()
    records: list[tuple[Any, ...]] = []
    roots: list[tuple[str, str]] = []
    for given in local_paths or []:
        root = os.path.realpath(given) if "://" not in given else given
        if "://" not in root and not os.path.isdir(root):
            logger.warning("Local path not found: %s", given)
            continue
        label = root.rstrip("/").rpartition("/")[2]
        records.append(("local", root, None, label, None, None))
        roots.append((label, root))
    named = spark.createDataFrame([(r,) for r in repos or {}], "spec string")
    for row in describe_sources(named).collect():  # one row per named repository
        checkout = (repos or {})[row["spec"]]
        if checkout is None:
            records.append(("remote", None, row["url"], row["label"], None, "clone_failed"))
        else:
            folder, sha = checkout if isinstance(checkout, tuple) else (checkout, None)
            records.append(("remote", None, row["url"], row["label"], sha, None))
            roots.append((row["label"], folder))
    docs = corpus.scan_tree(spark.createDataFrame(roots, "repo string, root string"))
    found = materialise(cd.candidates(docs, path_scope), "scan")
    scan = Scan(spark.createDataFrame(records, SOURCE_DDL), found, stamp)
    if output_path:
        reports.write_manifest(scan.manifest(), scan.sources, output_path, stamp, dry_run)
    return scan


@dataclass(frozen=True)
class Audit:
    """``documents`` have text, metadata and findings; ``results`` the findings without the text."""

    documents: DataFrame
    results: DataFrame
    rules: RuleSet
    created_at: str

    def findings(self) -> DataFrame:
        return au.findings(self.results)

    def files(self) -> DataFrame:
        return au.file_results(self.results)

    def summary(self) -> DataFrame:
        return au.summary(self.results)

    def by_severity(self) -> DataFrame:
        return au.by_severity(self.results)


def audit_manifest(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Documents of a stored manifest; entries whose text is gone are audited as empty."""
    texts = contents.select("abs_path", "content")
    joined = manifest.select("repo", "path", "abs_path", "content_hash").join(texts, "abs_path", "left")
    return joined.select(
        corpus.doc_key().alias("doc_key"), "repo", "path", "abs_path", F.coalesce("content", F.lit("")).alias("content"), "content_hash"
    )


def run_audit(
    docs: Scan | DataFrame | list[str],
    rules: RuleSet | None = None,
    output_path: str | None = None,
    report_md_path: str | None = None,
    dry_run: bool = True,
    spark: SparkSession | None = None,
) -> Audit:
    """Audit a scan, a document frame or a list of file paths (the latter needs ``spark``)."""
    stamp = utc_now()
    if isinstance(docs, Scan):
        docs = docs.candidates
    elif isinstance(docs, list):
        docs = corpus.scan_files(spark.createDataFrame([(p,) for p in docs], "path string"))
    used = rules or fetch_rules(docs.sparkSession, fetched_at=stamp)
    audited = au.audit_docs(docs, used)
    results = audited.select(*au.IDENTITY, "content_hash", "findings")
    if output_path or report_md_path:  # several reports read the results, so the texts are read once for all
        results = materialise(results, "audited")
    if output_path:
        reports.write_audit(results, used, output_path, stamp, dry_run)
    if report_md_path:
        reports.write_markdown(reports.audit_markdown(results, used, stamp, dry_run), report_md_path)
    return Audit(audited, results, used, stamp)


@dataclass(frozen=True)
class Plan:
    items: DataFrame
    findings: DataFrame
    rules: RuleSet
    created_at: str

    def summary(self) -> DataFrame:
        return pl.plan_summary(self.findings)


def run_plan(audit: Audit, output_path: str | None = None, report_md_path: str | None = None, dry_run: bool = True) -> Plan:
    stamp = utc_now()
    found = audit.findings()
    items = pl.plan_items(found)
    # The ranked table holds every finding, so the counts are taken from it and not from the texts.
    plan = Plan(items, items, audit.rules, stamp)
    if output_path:
        reports.write_plan(items, items, audit.rules, output_path, stamp, dry_run)
    if report_md_path:
        reports.write_markdown(reports.plan_markdown(items, items, stamp, dry_run), report_md_path)
    return plan


@dataclass(frozen=True)
class Fix:
    documents: DataFrame
    actions: DataFrame
    reaudit: DataFrame
    applied: bool
    written: DataFrame | None = None

    def fixed_docs(self) -> DataFrame:
        return fx.fixed_docs(self.documents)

    def summary(self) -> DataFrame:
        return au.summary(self.reaudit)

    def delta(self) -> DataFrame:
        return fx.fix_delta(self.reaudit)


def run_fix(
    audit: Audit,
    plan_items: DataFrame | None = None,
    apply: bool = False,
    dry_run: bool = True,
    output_path: str | None = None,
    in_place: bool = False,
    report_path: str | None = None,
) -> Fix:
    """Rewrite documents.

    All fixable findings are fixed, or those of ``plan_items`` where given.  With ``apply`` (and not
    ``dry_run``) the rewritten documents go to the table ``output_path``, or back to their files
    with ``in_place``.  ``report_path`` gets the actions and what an audit after the fixes finds.
    """
    effective = apply and not dry_run
    docs = audit.documents
    if plan_items is None:
        fixed = fx.fix_audited(docs, audit.rules)
    else:
        fixed = fx.fix_planned(plan_items, docs.select(*au.IDENTITY, "content", "findings"), audit.rules)
    written = None
    if effective:  # the changed texts are written once; sink, actions and re-audit read them back
        fixed = materialise(filter_once(fixed, F.col("touched")).drop("content_before"), "fixed")
        changed = fx.fixed_docs(fixed)
        if output_path:
            written = writers.write_docs(changed, output_path)
        if in_place:
            written = materialise(writers.write_files(changed), "written")
    done = Fix(fixed, fx.fix_actions(fixed, effective), fx.reaudit(fixed, audit.rules), effective, written)
    if report_path:
        reports.write_fix(done.actions, done.reaudit, report_path, utc_now(), effective)
    return done


@dataclass(frozen=True)
class Migration:
    planned: DataFrame
    actions: DataFrame
    documents: DataFrame
    pointers: DataFrame
    applied: bool

    def summary(self) -> DataFrame:
        return mg.migrate_summary(self.actions)

    def collisions(self) -> DataFrame:
        return mg.migrate_collisions(self.planned)


def run_migrate(
    docs: Scan | DataFrame,
    skills_root: str = "skills",
    skills_repo: str = mg.DEFAULT_REPO,
    apply: bool = False,
    allow_delete: bool = False,
    dry_run: bool = True,
    write_pointer: bool = True,
    output_path: str | None = None,
    in_place: bool = False,
    migrated_at: str | None = None,
    report_path: str | None = None,
) -> Migration:
    """Relocate documents; of several with one destination the last in document order stays.

    ``docs`` is a scan, a frame of documents, or the entries of a manifest: without a ``content`` column texts are read
    from ``abs_path``, and entries that name no file or one that cannot be read are skipped.

    With ``apply`` (and not ``dry_run``) the relocated documents and pointers go to tables below
    ``output_path``, or to files with ``in_place``.  Then the flags of ``actions`` tell what was done: a document whose
    destination could not be written keeps its source as it is and has ``applied`` false.
    """
    docs = docs.candidates if isinstance(docs, Scan) else docs
    if "content" not in docs.columns:
        named = docs.where(F.trim(F.coalesce("abs_path", F.lit(""))) != "")
        docs = materialise(corpus.read_files(named.select("repo", "path", "abs_path")), "manifest-texts")
    planned = mg.migrate_plan(with_frontmatter(docs), skills_root)
    effective = apply and not dry_run
    actions = mg.migrate_actions(planned, apply, allow_delete, dry_run, write_pointer)
    if effective:
        planned = materialise(planned.drop("content", "head"), "migration")
        actions = mg.migrate_actions(planned, apply, allow_delete, dry_run, write_pointer)
    rendered = mg.migrate_rendered(planned, migrated_at or utc_now())
    pointers = mg.migrate_pointers(planned, skills_repo)
    if effective and output_path:
        writers.write_by_domain(mg.surviving(rendered.withColumn("status", F.lit("ok"))).drop("status"), f"{output_path}/skills")
        actions.write.parquet(f"{output_path}/actions")
        if write_pointer:
            writers.write_docs(pointers, f"{output_path}/pointers")
    if effective and in_place:
        # A source is touched only after the copy that stays at its destination is known to be written.
        kept = mg.surviving(rendered.withColumn("status", F.lit("ok"))).drop("status")
        written = materialise(writers.write_files(kept, "dest_path"), "migrated").where("done").select(F.col("path").alias("dest_path"))
        copied = planned.where(F.col("status") == "ok").join(written, "dest_path")
        copied = materialise(copied.where(F.col("abs_path") != F.col("dest_path")).select("doc_key", "abs_path", "skill_id", "dest_rel", "repo", "path", "status"), "copied")
        none = copied.limit(0)
        pointed = materialise(writers.write_files(mg.migrate_pointers(copied, skills_repo)), "pointers") if write_pointer else none
        deleted = materialise(writers.delete_files(copied), "deleted") if allow_delete and not write_pointer else none
        done = [d if d is none else d.where("done").select(F.col("key").alias("doc_key")) for d in (pointed, deleted)]
        actions = mg.migrate_outcomes(actions, copied, *done)
    if report_path:
        options = {"allow_delete": allow_delete, "skills_root": skills_root, "skills_repo": skills_repo}
        reports.write_migrate(actions, report_path, utc_now(), effective, options)
    return Migration(planned, actions, rendered, pointers, effective)


def run_search(index: DocumentIndex, queries: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    return index.search(queries, top_k)
