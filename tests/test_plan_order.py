from pyspark.sql import functions as F

from docwarden.operators.plan import global_rank


def test_what_makes_the_rows_runs_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x * 7919 % 10007

    rows = spark.range(0, 3000, 1, 6).select(counted.asNondeterministic()("id").alias("v"), F.col("id"))
    ranked = global_rank(rows, ("v", "id"))
    got = sorted((r["rank"], r["v"], r["id"]) for r in ranked.collect())
    assert [g[0] for g in got] == list(range(1, 3001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert ranked.count() == 3000 and read.value == 3000
