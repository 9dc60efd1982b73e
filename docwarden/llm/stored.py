"""Intermediate tables in the shared scratch folder that can be dropped when they are no longer needed."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from docwarden.scratch import scratch_path


class Stored:
    """A frame written once; ``df`` reads the written table, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, name: str, buckets: int = 0, by: str = ""):
        spark = df.sparkSession
        self.spark, self.path, self.table = spark, scratch_path(spark, name), ""
        if buckets:
            self.table = f"docwarden_{uuid.uuid4().hex}"
            df.write.bucketBy(buckets, by).option("path", self.path).format("parquet").saveAsTable(self.table)
            self.df = spark.table(self.table)
        else:
            schema = df.schema
            df.write.parquet(self.path)
            self.df = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    The cleaner acts when the driver collects garbage, which a driver with little to do does rarely.  The last
    job is remembered until another one runs, so a tiny one runs first.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
