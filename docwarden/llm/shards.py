"""A uniform shuffle of documents into shards of exact sizes.

Every input partition ("cell") sends an exact number of rows to every target.  Those numbers, the
communication matrix, have a multivariate hypergeometric law, the one that a uniform permutation of all rows
would give.  The matrix is never stored: halving the cells again and again, one draw tells how a half's rows
spread over the targets, seeded by the half's bounds, so each task finds its own row of the matrix, and how many
rows earlier cells send, in logarithmic time and always the same.  Each cell is permuted locally, rows are
exchanged, and each target is permuted again.  Targets are blocks of bounded size; a shard is some blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.scratch import materialise

#: Rows of a block at most; what a task permutes after the exchange.
BLOCK_ROWS = 1 << 16


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement, for totals of any size.

    Below numpy's bound of 10**9 its sampler is used, beyond it the ratio of uniforms with the same law.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mode = int((draws + 1) * (good + 1) / (total + 2))
    mode = min(max(mode, low), high)
    mean = draws * good / total
    spread = math.sqrt(max(mean * (bad / total) * ((total - draws) / (total - 1)), 0.0) + 0.5)
    peak = _log_choose(good, mode) + _log_choose(bad, draws - mode)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u > 0 else low - 1
        if low <= x <= high and 2 * math.log(u) <= _log_choose(good, x) + _log_choose(bad, draws - x) - peak:
            return x


def spread_rows(rng: np.random.Generator, room: np.ndarray, rows: int) -> np.ndarray:
    """How ``rows`` rows drawn without replacement spread over targets with so much room."""
    out = np.zeros(len(room), dtype=np.int64)
    if int(room.sum()) < 1_000_000_000:
        return rng.multivariate_hypergeometric(room, rows, method="marginals") if rows else out
    rest = int(room.sum())
    for k, size in enumerate(room.tolist()):
        if not rows:
            break
        rest -= size
        out[k] = hypergeometric(rng, size, rest, rows)
        rows -= int(out[k])
    return out


def matrix_row(cell: int, bounds: np.ndarray, targets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ``cell`` sends to each target, and rows that earlier cells send there.

    ``bounds`` are the running totals of the cells' rows, from 0.
    """
    low, high = 0, len(bounds) - 1
    room, before = targets.astype(np.int64), np.zeros(len(targets), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = spread_rows(rng, room, int(bounds[middle] - bounds[low]))
        if cell < middle:
            room, high = left, middle
        else:
            room, before, low = room - left, before + left, middle
    return room, before


def block_sizes(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all blocks and the shard of each; shards differ by one row at most."""
    sizes, owner = [], []
    for s in range(shards):
        size = rows // shards + (s < rows % shards)
        blocks = max(1, -(-size // block_rows))
        sizes += [size // blocks + (b < size % blocks) for b in range(blocks)]
        owner += [s] * blocks
    return np.array(sizes, dtype=np.int64), np.array(owner, dtype=np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows of ``docs`` with their shard and their gapless place in it, from 0.

    Any assignment of rows to places is equally likely under a random ``seed``; with a fixed seed the same
    input in the same partitions gives the same result, also when tasks are repeated, since rows and their
    cells are written once before the draw.  Shard sizes differ by one row at most.  Nulls, empty and long
    texts and repeated rows are rows like any other; an empty table gives an empty result.  Columns that
    have the name of a new one are replaced.  Equal texts are not kept together.

    Per row one exchange; the driver holds one number per input partition and per block.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kept = docs.drop(shard, slot)
    cells = kept.withColumns({"_cell": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    written = materialise(cells, "shard-cells")
    counts = {r["_cell"]: r["n"] for r in written.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts)
    bounds = np.concatenate([[0], np.cumsum([counts[c] for c in order])]).astype(np.int64)
    sizes, owner = block_sizes(int(bounds[-1]), shards, block_rows)
    offset = np.concatenate([np.arange(0), *(np.cumsum(sizes[owner == s]) - sizes[owner == s] for s in range(shards))]).astype(np.int64)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((np.array(order, dtype=np.int64), bounds, sizes, owner, offset))

    @F.pandas_udf("struct<block:int,place:long,shard:int,start:long>")
    def sent(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        order, bounds, sizes, owner, offset = shared.value
        last, plan = -1, None
        for cell, row in parts:
            cell, row = cell.to_numpy(), row.to_numpy()
            block, place = np.empty(len(cell), np.int32), np.empty(len(cell), np.int64)
            for c in np.unique(cell):
                if c != last:
                    k = int(np.searchsorted(order, c))
                    sends, before = matrix_row(k, bounds, sizes, seed)
                    mixed = np.random.default_rng([seed, 1, int(c)]).permutation(int(sends.sum()))
                    last, plan = c, (mixed, np.cumsum(sends), before, sends)
                mixed, upto, before, sends = plan
                at = np.flatnonzero(cell == c)
                turn = mixed[row[at]]
                to = np.searchsorted(upto, turn, side="right")
                block[at] = to
                place[at] = before[to] + turn - (upto[to] - sends[to])
            yield pd.DataFrame({"block": block, "place": place, "shard": owner[block].astype(np.int32), "start": offset[block]})

    columns = [F.col(f"`{c}`") for c in kept.columns]
    arrival = [F.col(f"_to.{c}").alias(f"_{c}") for c in ("block", "place", "shard", "start")]
    moved = written.withColumn("_to", sent("_cell", "_row")).select(*columns, *arrival)
    # The second permutation orders a block's rows by seeded random numbers; equal ones by the place of arrival.
    within = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), F.lit(2), "_block", "_place"), "_place")
    placed = moved.withColumn("_turn", F.row_number().over(within) - 1)
    return placed.select(*columns, F.col("_shard").alias(shard), (F.col("_start") + F.col("_turn")).alias(slot))
