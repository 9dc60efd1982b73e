"""Rank findings into a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.operators.rules import with_scores
from docwarden.scratch import materialise

ORDER = ("score", "repo", "path", "abs_path", "rule_ord")
ITEM_COLUMNS = (
    "rank",
    "doc_key",
    "repo",
    "path",
    "abs_path",
    "rule_id",
    "name",
    "severity",
    "effort",
    "fixable",
    "risk",
    "description",
    "action",
)


def global_rank(df: DataFrame, order: tuple[str, ...], name: str = "rank") -> DataFrame:
    """Add consecutive numbers 1..n in the given total order, without one task seeing all rows.

    The rows are written before they are ordered, so that the sample behind the range borders reads the
    key columns of that table and does not run all that made the rows once more.  Range-partitioned and sorted
    they are written again: the borders must not be drawn anew between counting a partition and numbering
    its rows.  The number of a row is its position in its partition plus the sizes of the partitions before; only one
    row per partition is gathered for those sums.
    """
    rows = materialise(df, "unranked")
    sorted_rows = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    written = materialise(sorted_rows, "ranked")
    part = F.shiftright(F.col("_at"), 33)
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = written.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per partition
    offsets, before = {}, 0
    for row in sizes:
        offsets[row["part"]] = before
        before += row["count"]
    starts = df.sparkSession.createDataFrame(sorted(offsets.items()), "part long, before long")
    return (
        written.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .withColumn(name, F.col("before") + inside + 1)
        .drop("part", "before", "_at")
    )


def plan_items(found: DataFrame) -> DataFrame:
    """Findings as ranked items with risk and advice.  Ties go by document, then rule order."""
    scored = with_scores(found, "rule_id").select("score", "rule_ord", *[c for c in ITEM_COLUMNS if c != "rank"])
    return global_rank(scored, ORDER).select(*ITEM_COLUMNS)


def plan_summary(found: DataFrame) -> DataFrame:
    """Counts of findings or plan items as ``(dimension, key, n)``: total, fixable, per severity and per risk."""
    scored = found if "risk" in found.columns else with_scores(found, "rule_id")
    # The first step leaves a few rows; the grouping sets run over those.
    cells = scored.groupBy("severity", "risk").agg(F.count("*").alias("n"), F.count_if("fixable").alias("fixable"))
    # An empty cell keeps the totals of an empty plan.
    none_found = found.sparkSession.range(0, 1, 1, 1).selectExpr(
        "CAST(NULL AS STRING) AS severity", "CAST(NULL AS STRING) AS risk", "0L AS n", "0L AS fixable"
    )
    sets = cells.unionByName(none_found).groupingSets([["severity"], ["risk"], []], "severity", "risk").agg(
        F.sum("n").alias("n"), F.sum("fixable").alias("fixable"), F.grouping_id().alias("gid")
    )
    sets = sets.where((F.col("gid") == 3) | (F.col("n") > 0))
    by_field = F.when(F.col("gid") == 1, "severity").when(F.col("gid") == 2, "risk")
    entry = lambda d, k, n: F.struct(d.alias("dimension"), k.alias("key"), F.coalesce(n, F.lit(0)).alias("n"))
    none = F.lit(None).cast("string")
    rows = F.when(
        F.col("gid") == 3,
        F.array(entry(F.lit("total"), none, F.col("n")), entry(F.lit("fixable"), none, F.col("fixable"))),
    ).otherwise(F.array(entry(by_field, F.coalesce("severity", "risk"), F.col("n"))))
    return sets.select(F.inline(rows))
