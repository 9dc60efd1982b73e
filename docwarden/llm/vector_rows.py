"""Vector columns of Arrow batches as numpy matrices, and frames with added columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Rows handled at once.
ROWS = 8192


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lengths(column: pa.Array) -> np.ndarray:
    """Components of every vector; -1 for null."""
    return np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors with ``dim`` components, none of them null or not finite, and these in float64."""
    size = lengths(column)
    values = pc.cast(column.flatten(), pa.float64())
    values = np.asarray(pc.fill_null(values, float("nan")))
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    row = np.flatnonzero(size == dim)
    found = values[start[row][:, None] + np.arange(dim)] if len(row) else np.zeros((0, dim))
    finite = np.isfinite(found).all(axis=1)
    return row[finite], found[finite]


def with_fields(schema: T.StructType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])
