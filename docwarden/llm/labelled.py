"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int, highest: bool = True) -> DataFrame:
    """``_text, _y`` of at most about ``max_rows`` labelled documents, chosen by a hash of the id.

    Null labels and ids are left out; of several labels of one id the highest (or lowest) counts.
    """
    pick = F.max if highest else F.min
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(pick(F.col(label).cast("int")).alias("_y"))
    n = known.count()
    if n > max_rows:
        share = int(max_rows / n * (1 << 31))
        known = known.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 31)) < share)
    # Two numbers a row and about max_rows of them at most: a broadcast of bounded size.
    return docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(known), key).select("_text", "_y")
