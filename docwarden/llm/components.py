"""Connected components of a table of links, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import Stored


def _state(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"] or 0


def connected_components(links: DataFrame) -> Stored:
    """``node, root`` for every node of ``links(a, b)``; root is the least node that can be reached.

    Large and small stars in turn: every node points its larger neighbours, then its smaller ones, at the
    least node it knows, until nothing changes, which takes about the logarithm of the longest path.  Each round
    is written to the shared scratch folder.  Nodes and links stay in tables; the driver sees two sums a round.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = Stored(links.where("a <> b").select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = _state(now.df)
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before the join, so that Spark can split the rows of a node with very many links among tasks.
        least = Stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        large = both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step = Stored(large, "large-stars")
        small_least = step.df.groupBy("u").agg(F.min("v").alias("m"))
        small = step.df.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("l"))
        after = Stored(small.select("l.u", "l.v").where("u <> v").distinct(), "small-stars")
        for t in (step, now, least):
            t.drop()
        now, before, state = after, state, _state(after.df)
        if state == before:
            break
    roots = now.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    own = now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = Stored(roots.unionByName(own), "components")
    now.drop()
    return out
