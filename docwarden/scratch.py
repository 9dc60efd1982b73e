"""Where intermediate tables go, and how they are written.

A frame that several later steps read (and whose layout must not change between those reads) is
written once as a Parquet table below ``spark.checkpoint.dir``.  That folder is shared by all
executors, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
        base = _local_folders.get(app) or tempfile.mkdtemp(prefix="docwarden-")
        _local_folders[app] = base
    return f"{base.rstrip('/')}/docwarden-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them stop working."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
