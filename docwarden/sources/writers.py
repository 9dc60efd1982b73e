"""Sinks for changed documents: as tables, or as files of a mounted or remote tree.

Nothing is ever written over the table a job reads; trees are changed in place only when asked to.
"""

from __future__ import annotations

import errno
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.sources.corpus import addressed
from docwarden.sources.files import delete_file, write_bytes


def write_docs(docs: DataFrame, path: str) -> DataFrame:
    """Write documents as a table and return the stored frame."""
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def write_by_domain(docs: DataFrame, path: str) -> DataFrame:
    """Write relocated documents in one folder per domain.

    Rebalancing splits a domain that holds much of the corpus over many tasks and files.
    """
    docs.hint("rebalance", "domain").write.partitionBy("domain").parquet(path)
    # With a schema, a domain such as 007 stays text.
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


_DONE = "path string, key string, done boolean"


# What will be no different the next time; any other failure fails the task, which is then repeated.
_FINAL = {errno.ENOENT, errno.EACCES, errno.EPERM, errno.ENOTDIR, errno.EISDIR, errno.EEXIST, errno.ENOTEMPTY, errno.ENAMETOOLONG, errno.EROFS, errno.EINVAL, errno.ELOOP}


def _is_final(failed: OSError) -> bool:
    return failed.errno in _FINAL or isinstance(failed, FileNotFoundError | PermissionError | NotADirectoryError | IsADirectoryError | FileExistsError)


def _write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        done = []
        for path, content in zip(pdf["address"], pdf["content"]):
            try:
                write_bytes(path, content.encode("utf-8"))
                done.append(True)
            except OSError as failed:
                if not _is_final(failed):
                    raise
                done.append(False)
        yield pdf.drop(columns=["address", "content"]).assign(done=done)


def _delete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        done = []
        for path in pdf["address"]:
            try:
                delete_file(path)
                done.append(True)
            except FileNotFoundError:
                done.append(True)  # this task ran before, on an executor that was lost
            except OSError as failed:
                if not _is_final(failed):
                    raise
                done.append(False)
        yield pdf.drop(columns="address").assign(done=done)


# Rows that are Python values at the same time; Spark hands over up to 10 000 in a batch.
_ROWS = 256
_RESULT = pa.schema([("path", pa.string()), ("key", pa.string()), ("done", pa.bool_())])


def _in_pieces(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on pieces of Arrow batches, so that a batch of long texts is not copied as a whole."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (batch.slice(at, _ROWS).to_pandas() for batch in batches for at in range(0, batch.num_rows, _ROWS))
        for done in run(pieces):
            yield pa.RecordBatch.from_pandas(done, schema=_RESULT, preserve_index=False)

    return go


def _named(docs: DataFrame, path: str) -> DataFrame:
    key = F.col("doc_key") if "doc_key" in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({"key": key, "address": addressed(docs.sparkSession, F.col(path))})


def write_files(docs: DataFrame, path: str = "abs_path") -> DataFrame:
    """Write ``content`` of every row to the file it names; ``done`` tells which succeeded."""
    return _named(docs, path).select(F.col(path).alias("path"), "key", "address", "content").mapInArrow(_in_pieces(_write), _DONE)


def delete_files(docs: DataFrame, path: str = "abs_path") -> DataFrame:
    """Delete the files that rows name; ``done`` tells which are gone, also those that were gone before."""
    return _named(docs, path).select(F.col(path).alias("path"), "key", "address").mapInArrow(_in_pieces(_delete), _DONE)
