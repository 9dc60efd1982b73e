"""Reports as rows of text or JSON, and the sinks that write them.

Markdown reports are frames ``(part, repo, path, abs_path, line_no, text)``; sorted by all but the
last column they are the report.  The sort is a range sort, so a report of any length is written by
many tasks as numbered files.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.operators import audit as au
from docwarden.operators.migrate import migrate_summary
from docwarden.operators.plan import plan_summary
from docwarden.operators.rules import SEVERITY_ORDER, RuleSet
from docwarden.scratch import materialise
from docwarden.sources.corpus import doc_key

LINE_ORDER = ("part", "repo", "path", "abs_path", "line_no")
LAST = 99  # fixed value: sort place of unknown severities
# Titles, headings and table heads of the two Markdown reports.
AUDIT_TITLE, PLAN_TITLE = "# Audit Report", "# Improvement Plan"
RULE_SOURCE, SUMMARY, FINDINGS = "## Rule Source", "## Summary", "## Findings"
BY_SEVERITY, BY_RISK, ITEMS = "### By Severity", "### By Risk", "## Prioritised Action Items"
AUDIT_COUNTS = ["| Files audited | Total findings | Errors | Warnings | Info |", "|---|---|---|---|---|"]
FINDING_TABLE = ["| Rule | Severity | Description |", "|---|---|---|"]
SEVERITY_TABLE = ["| Severity | Count |", "|---|---|"]
RISK_TABLE = ["| Risk | Count |", "|---|---|"]
ITEM_TABLE = ["| # | File | Rule | Severity | Effort | Risk | Fixable | Action |", "|---|---|---|---|---|---|---|---|"]


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def _head(df: DataFrame, part: int, lines: list[Column | str]) -> DataFrame:
    """Lines made from a one-row frame."""
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    none = F.lit("")
    return df.select(
        F.lit(part).alias("part"), none.alias("repo"), none.alias("path"), none.alias("abs_path"), F.posexplode(texts).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("long"))


def _yes(flag: bool) -> str:
    return "True" if flag else "False"


def audit_markdown(audited: DataFrame, rules: RuleSet, created_at: str, dry_run: bool = True) -> DataFrame:
    """Header, rule source, summary table, then one table per document with findings."""
    origin = rules.provenance()
    top = [
        AUDIT_TITLE,
        "",
        f"**Generated:** {created_at}  ",
        f"**Dry-run:** {_yes(dry_run)}  ",
        "",
        RULE_SOURCE,
        "",
        f"- **URL:** {origin['source_url']}",
        f"- **Commit SHA:** `{origin['commit_sha']}`",
        f"- **Fetched at:** {origin['fetched_at']}",
        f"- **Using baseline:** {_yes(origin['is_baseline'])}",
        "",
        SUMMARY,
        "",
        *AUDIT_COUNTS,
        _joined("| ", F.col("files_audited"), " | ", F.col("total_findings"), " | ", F.col("error"), " | ", F.col("warning"), " | ", F.col("info"), " |"),
        "",
        FINDINGS,
        "",
    ]
    head = _head(au.summary(audited), 0, top)
    rows = F.transform("findings", lambda f: _joined("| `", f["rule_id"], "` | ", f["severity"], " | ", f["description"], " |"))
    title = _joined("### `", F.col("repo"), "/", F.col("path"), "`")
    section = F.concat(F.array(title, F.lit(""), *map(F.lit, FINDING_TABLE)), rows, F.array(F.lit("")))
    body = audited.where(F.size("findings") > 0).select(
        F.lit(1).alias("part"), "repo", "path", "abs_path", F.posexplode(section).alias("line_no", "text")
    )
    return head.unionByName(body.withColumn("line_no", F.col("line_no").cast("long")))


def plan_markdown(items: DataFrame, found: DataFrame, created_at: str, dry_run: bool = True) -> DataFrame:
    """Header, counts by severity and risk, then the ranked items."""
    counts = materialise(plan_summary(found), "plan-counts")  # a few rows that six parts below read
    empty = F.lit("")
    number = lambda dimension: F.sum(F.when(F.col("dimension") == dimension, F.col("n")))
    totals = counts.agg(number("total").alias("total"), number("fixable").alias("fixable"))
    top = [
        PLAN_TITLE,
        "",
        f"**Generated:** {created_at}  ",
        f"**Dry-run:** {_yes(dry_run)}  ",
        "",
        SUMMARY,
        "",
        _joined("- **Total items:** ", F.coalesce("total", F.lit(0))),
        _joined("- **Auto-fixable:** ", F.coalesce("fixable", F.lit(0))),
        "",
        BY_SEVERITY,
        "",
        *SEVERITY_TABLE,
    ]
    middle = ["", BY_RISK, "", *RISK_TABLE]
    heading = ["", ITEMS, "", *ITEM_TABLE]
    place = F.lit(LAST)
    for name, at in SEVERITY_ORDER.items():
        place = F.when(F.col("key") == name, at).otherwise(place)

    def table(part: int, dimension: str, order: Column) -> DataFrame:
        # The second sort column is the key itself: by name for risks, after the known order for severities.
        return counts.where(F.col("dimension") == dimension).select(
            F.lit(part).alias("part"),
            F.lpad(order.cast("string"), 3, "0").alias("repo"),
            F.col("key").alias("path"),
            empty.alias("abs_path"),
            F.lit(0).cast("long").alias("line_no"),
            _joined("| ", F.col("key"), " | ", F.col("n"), " |").alias("text"),
        )

    mark = F.when(F.col("fixable"), "✅").otherwise("❌")
    line = _joined(
        "| ", F.col("rank"), " | `", F.col("repo"), "/", F.col("path"), "` | `", F.col("rule_id"), "` | ", F.col("severity"),
        " | ", F.col("effort"), " | ", F.col("risk"), " | ", mark, " | ", F.col("action"), " |",
    )
    listed = items.select(
        F.lit(5).alias("part"), empty.alias("repo"), empty.alias("path"), empty.alias("abs_path"), F.col("rank").alias("line_no"), line.alias("text")
    )
    parts = [
        _head(totals, 0, top),
        table(1, "severity", place),
        _head(totals, 2, middle),
        table(3, "risk", F.lit(0)),
        _head(totals, 4, heading),
        listed,
        _head(totals, 6, [""]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_markdown(lines: DataFrame, path: str) -> None:
    """Text files that, read in name order, are the report."""
    lines.orderBy(*LINE_ORDER).select("text").write.text(path)


def findings_json(column: str = "findings") -> Column:
    """Findings of one document as JSON, details only where a rule has them."""
    shown = F.transform(
        column,
        lambda f: F.struct(
            f["rule_id"].alias("rule_id"),
            f["name"].alias("name"),
            f["severity"].alias("severity"),
            f["description"].alias("description"),
            f["effort"].alias("effort"),
            f["fixable"].alias("fixable"),
            f["schema_errors"].alias("schema_errors"),
            f["missing_fields"].alias("missing_fields"),
        ),
    )
    return F.to_json(shown)


def _meta(spark, path: str, meta: dict[str, Any], summary: DataFrame | None = None, name: str = "summary") -> None:
    """One JSON record: run metadata and, beside it, the summary's columns."""
    fixed = {k: v for k, v in meta.items() if v is not None}
    base = spark.range(1) if summary is None else summary
    kept = [] if summary is None else [F.struct(*summary.columns).alias(name)]

    def literal(v: Any) -> Column:
        return F.struct(*[literal(x).alias(k) for k, x in v.items()]) if isinstance(v, dict) else F.lit(v)

    base.select(*[literal(v).alias(k) for k, v in fixed.items()], *kept).write.json(path)


def write_manifest(entries: DataFrame, sources: DataFrame, path: str, created_at: str, dry_run: bool = True) -> None:
    spark = entries.sparkSession
    _meta(spark, f"{path}/manifest", {"schema_version": "1", "created_at": created_at, "dry_run": dry_run})
    sources.write.json(f"{path}/sources")
    entries.write.json(f"{path}/candidates")


def write_audit(audited: DataFrame, rules: RuleSet, path: str, created_at: str, dry_run: bool = True) -> None:
    meta = {"schema_version": "1", "created_at": created_at, "dry_run": dry_run, "rule_source": rules.provenance()}
    _meta(audited.sparkSession, f"{path}/report", meta, au.summary(audited))
    au.by_severity(audited).write.json(f"{path}/by_severity")
    au.file_results(audited).drop("doc_key").write.json(f"{path}/files")


def write_plan(items: DataFrame, found: DataFrame, rules: RuleSet, path: str, created_at: str, dry_run: bool = True) -> None:
    meta = {"schema_version": "1", "created_at": created_at, "dry_run": dry_run, "rule_source": rules.provenance()}
    _meta(items.sparkSession, f"{path}/plan", meta)
    plan_summary(found).write.json(f"{path}/summary")
    items.write.json(f"{path}/items")


def write_fix(actions: DataFrame, reaudit: DataFrame, path: str, created_at: str, applied: bool) -> None:
    """Options, number of actions and summary of the audit after the fixes in one row; the actions as a table."""
    stored = actions.drop("doc_key")
    stored.write.json(f"{path}/actions")
    count = actions.sparkSession.read.schema(stored.schema).json(f"{path}/actions").count()
    meta = {"schema_version": "1", "created_at": created_at, "dry_run": not applied, "applied": applied, "actions_count": count}
    _meta(actions.sparkSession, f"{path}/fix", meta, au.summary(reaudit), "post_fix_audit_summary")


def write_migrate(actions: DataFrame, path: str, created_at: str, applied: bool, options: dict[str, Any]) -> None:
    """Options and the four counts in one row; the actions as a table."""
    stored = actions.drop("doc_key")
    stored.write.json(f"{path}/actions")
    again = actions.sparkSession.read.schema(stored.schema).json(f"{path}/actions")
    meta = {"schema_version": "1", "created_at": created_at, "dry_run": not applied, "applied": applied, **options}
    _meta(actions.sparkSession, f"{path}/migrate", meta, migrate_summary(again))


# ---------------------------------------------------------------------------------------------
# Reading stored reports back


_IDENTITY_DDL = "repo string, path string, abs_path string"
_FINDING_DDL = "rule_id string, name string, severity string, description string, effort string, fixable boolean, schema_errors array<string>, missing_fields array<string>"


_FINDING_NAMES = [part.split()[0] for part in _FINDING_DDL.split(", ")]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of a stored manifest."""
    kinds = f"{_IDENTITY_DDL}, content_hash string, has_frontmatter boolean, frontmatter string, size_bytes long"
    return spark.read.schema(kinds).json(f"{path}/candidates")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The files of a stored audit report with their findings, keyed as documents are."""
    kinds = f"{_IDENTITY_DDL}, content_hash string, finding_count long, findings array<struct<{_FINDING_DDL.replace(' ', ':').replace(',:', ',')}>>"
    stored = spark.read.schema(kinds).json(f"{path}/files")
    # A file's findings are stored in rule order.
    numbered = F.transform("findings", lambda f, i: F.struct(i.alias("rule_ord"), *(f[c].alias(c) for c in _FINDING_NAMES)))
    return stored.withColumns({"findings": numbered, "doc_key": doc_key()})


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The items of a stored plan, keyed as documents are."""
    kinds = f"rank long, {_IDENTITY_DDL}, rule_id string, name string, severity string, effort string, fixable boolean, risk string, description string, action string"
    return spark.read.schema(kinds).json(f"{path}/items").withColumn("doc_key", doc_key())


_COUNT_DDL = "files_audited: long, total_findings: long, error: long, warning: long, info: long"


def read_fix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row of options and counts, and the actions."""
    kinds = f"schema_version string, created_at string, dry_run boolean, applied boolean, actions_count long, post_fix_audit_summary struct<{_COUNT_DDL}>"
    actions = "repo string, path string, abs_path string, rule_id string, applied boolean, diff_summary string"
    return spark.read.schema(kinds).json(f"{path}/fix"), spark.read.schema(actions).json(f"{path}/actions")


def read_migrate(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row of options and counts, and the actions."""
    kinds = (
        "schema_version string, created_at string, dry_run boolean, applied boolean, allow_delete boolean, skills_root string, skills_repo string, "
        "summary struct<total: long, applied: long, pointers_written: long, deleted: long>"
    )
    actions = "skill_id string, repo string, path string, source_path string, dest_path string, dest_rel string, domain string, status string, applied boolean, deleted_source boolean, wrote_pointer boolean"
    return spark.read.schema(kinds).json(f"{path}/migrate"), spark.read.schema(actions).json(f"{path}/actions")
