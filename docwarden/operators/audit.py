"""Evaluate the rule table over documents.

The rules of one document are tested in one projection: parsing, tests and findings need no shuffle.
``findings`` stays an array beside the document until a step asks for one row per finding, so clean
documents are never lost and later stages can read text and findings from the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import schema
from docwarden.functions.frontmatter import with_frontmatter
from docwarden.functions.shaping import inline_once, sql_literal
from docwarden.operators.rules import ATTRIBUTES, Doc, RuleSet, fires

IDENTITY = ("doc_key", "repo", "path", "abs_path")
SEVERITIES = ("error", "warning", "info")
_ATTRIBUTE_TYPES = {a: "boolean" if a == "fixable" else "string" for a in ATTRIBUTES}


def with_schema_errors(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("schema_errors", schema.schema_errors("fm"))


def _finding(rule: dict, doc: Doc) -> Column:
    """The finding of one rule, NULL where it does not fire; all but the test is a literal."""
    details = {
        "FM002": ("transform(schema_errors, e -> concat(e.path, ': ', e.message))", "NULL"),
        "FM003": ("NULL", schema.missing_sql("fm")),
    }
    errors, missing = details.get(rule["id"], ("NULL", "NULL"))
    attributes = ", ".join(f"'{a}', CAST({sql_literal(rule[a])} AS {_ATTRIBUTE_TYPES[a]})" for a in ATTRIBUTES)
    finding = (
        f"named_struct('rule_ord', {int(rule['ord'])}, 'rule_id', {sql_literal(rule['id'])}, {attributes}, "
        f"'schema_errors', CAST({errors} AS ARRAY<STRING>), 'missing_fields', CAST({missing} AS ARRAY<STRING>))"
    )
    return F.when(fires(rule["id"], doc), F.expr(finding))


def _with_findings(checked: DataFrame, rules: RuleSet) -> DataFrame:
    doc = Doc.of_row()
    found = [_finding(rule, doc) for rule in rules.checked()]
    empty = (
        "array<struct<rule_ord:int,rule_id:string,name:string,severity:string,description:string,"
        "effort:string,fixable:boolean,schema_errors:array<string>,missing_fields:array<string>>>"
    )
    column = F.array_compact(F.array(*found)) if found else F.array().cast(empty)
    return checked.withColumn("findings", column)


def audit_parsed(parsed: DataFrame, rules: RuleSet) -> DataFrame:
    """As :func:`audit_docs`, for documents whose metadata is already parsed."""
    return _with_findings(with_schema_errors(parsed), rules)


def audit_docs(docs: DataFrame, rules: RuleSet) -> DataFrame:
    """Documents with ``findings``; works on a streaming frame as well."""
    return audit_parsed(with_frontmatter(docs), rules)


def findings(audited: DataFrame) -> DataFrame:
    """One row per finding."""
    return inline_once(audited, "findings", *IDENTITY)


def file_results(audited: DataFrame) -> DataFrame:
    """One row per document, also where nothing was found."""
    return audited.select(
        *IDENTITY, "content_hash", F.size("findings").cast("long").alias("finding_count"), "findings"
    )


def by_severity(audited: DataFrame) -> DataFrame:
    """Findings per severity; the three known ones are always listed."""
    known = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(0).cast("long").alias("n")) for s in SEVERITIES])
    zeros = audited.sparkSession.range(0, 1, 1, 1).select(F.inline(known))
    counted = inline_once(audited, "findings").groupBy("severity").agg(F.count("*").alias("n"))
    return zeros.unionByName(counted).groupBy("severity").agg(F.sum("n").alias("n"))


def summary(audited: DataFrame) -> DataFrame:
    """One row: documents, findings, and findings of each known severity."""
    def of(severity: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["severity"] == severity))

    per_severity = [F.sum(of(s)).alias(s) for s in SEVERITIES]
    counts = audited.agg(
        F.count("*").alias("files_audited"), F.sum(F.size("findings")).alias("total_findings"), *per_severity
    )
    return counts.select("files_audited", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_findings", *SEVERITIES)])
