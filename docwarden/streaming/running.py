"""Totals of an audit that go along with arriving documents.

Spark keeps the state: findings per rule and severity, and per destination the number of sources and the last of them in
document order.  Every batch hands on the totals that it changed; they are written under the number of the batch, so
a batch that runs again after a failure replaces what it wrote before and counts nothing twice.  The totals of a key
are those of its last batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docwarden.functions.frontmatter import with_frontmatter
from docwarden.operators.audit import audit_docs, findings
from docwarden.operators.migrate import WRITE_ORDER, migrate_plan
from docwarden.operators.rules import RuleSet

_COUNTS = "rule_id string, severity string, n long, batch long"
_PLACES = "dest_rel string, n_sources long, kept_key string, kept string, batch long"


def _totals(changed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of changed totals until all that is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        # The folder of a batch is its own, so other batches are not touched and a repeated one replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, path: str, schema: str, *key: str) -> DataFrame:
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    values = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*key, *[F.col(f"v.{c}").alias(c) for c in values])


def count_findings(docs: DataFrame, rules: RuleSet, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the findings per rule and severity of a streaming frame of documents; the state is a row per rule."""
    found = findings(audit_docs(docs, rules)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    return _totals(found, path, checkpoint)


def finding_counts(spark: SparkSession, path: str) -> DataFrame:
    """``rule_id, severity, n`` of all documents so far."""
    return _last(spark, path, _COUNTS, "rule_id", "severity")


def keep_destinations(docs: DataFrame, path: str, checkpoint: str, skills_root: str = "skills") -> StreamingQuery:
    """Keep, for every destination, how many documents go there and the last of them in document order.

    The state is a row per destination, spread by its hash; a batch writes the destinations it touched.
    """
    planned = migrate_plan(with_frontmatter(docs), skills_root).where(F.col("status") == "ok")
    last = F.max(F.struct(*WRITE_ORDER, "doc_key"))
    kept = planned.groupBy("dest_rel").agg(F.count("*").alias("n_sources"), last.alias("last"))
    return _totals(kept.select("dest_rel", "n_sources", F.col("last.doc_key").alias("kept_key"), F.col("last.abs_path").alias("kept")), path, checkpoint)


def destinations(spark: SparkSession, path: str) -> DataFrame:
    """``dest_rel, n_sources, kept_key, kept`` of all documents so far."""
    return _last(spark, path, _PLACES, "dest_rel")
