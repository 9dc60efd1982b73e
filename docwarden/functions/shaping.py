"""Small helpers that keep a plan in the intended shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, with the columns the condition reads computed once per row.

    A plain filter is pushed below the projection that makes those columns, which copies their
    expressions (rewritten texts, say) into the condition once per mention.  The partition number
    in the projection keeps the filter above it.
    """
    return (
        df.withColumns({"_keep": condition, "_part": F.spark_partition_id()})
        .where(F.col("_keep") & (F.col("_part") >= 0))
        .drop("_keep", "_part")
    )


def inline_once(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``df.select(*keep, inline(column))``, with the array computed once per row.

    An inner explode makes Catalyst test the array for emptiness first, by a second copy of the
    expression behind it; the outer form does not, and its empty rows are dropped here.
    """
    rows = df.select(*keep, F.explode_outer(column).alias("_x")).where(F.col("_x").isNotNull())
    return rows.select(*keep, "_x.*")


def explode_once(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    """As :func:`inline_once`, for arrays without NULL elements."""
    return df.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sql_literal(value: str | bool | None) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
