from pyspark.sql import functions as F

from docwarden.functions.frontmatter import with_frontmatter
from docwarden.operators import audit as au
from docwarden.operators import migrate as mg
from docwarden.plans.chained import _forget_last_commit
from docwarden.sources.corpus import as_docs
from docwarden.streaming import running as ru
from tests.helpers import BARE, BROKEN, CLEAN, PARTIAL, RULES


def test_totals_equal_a_batch_job_after_a_repeated_batch(spark, tmp_path):
    texts = [CLEAN, BARE, PARTIAL, BROKEN, CLEAN.replace("log-reader", "Other Id"), CLEAN, BARE]
    rows = [("o/r", f"same.{i}", f"/x/same.{i}", t) for i, t in enumerate(texts)]
    docs = as_docs(spark.createDataFrame(rows, "repo string, path string, abs_path string, content string"))
    inbox, found, places = str(tmp_path / "inbox"), str(tmp_path / "found"), str(tmp_path / "places")
    assert ru.finding_counts(spark, found).count() == ru.destinations(spark, places).count() == 0

    def run():
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        ru.count_findings(stream, RULES, found, str(tmp_path / "c1")).awaitTermination()
        ru.keep_destinations(stream, places, str(tmp_path / "c2")).awaitTermination()

    def compare(have):
        counts = au.findings(au.audit_docs(have, RULES)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
        assert sorted(ru.finding_counts(spark, found).collect()) == sorted(counts.collect())
        plan = mg.migrate_plan(with_frontmatter(have)).where("status = 'ok'")
        last = plan.groupBy("dest_rel").agg(F.count("*").alias("n"), F.max(F.struct(*mg.WRITE_ORDER, "doc_key")).alias("l"))
        want = last.select("dest_rel", "n", "l.doc_key", "l.abs_path")
        assert sorted(map(tuple, ru.destinations(spark, places).collect())) == sorted(map(tuple, want.collect()))

    for at in (5, 2, 6, 0):  # not in document order
        docs.where(F.col("path") == f"same.{at}").coalesce(1).write.mode("append").parquet(inbox)
    run()
    compare(docs.where(F.col("path").isin("same.5", "same.2", "same.6", "same.0")))
    for checkpoint in ("c1", "c2"):
        _forget_last_commit(spark, str(tmp_path / checkpoint))
    run()
    compare(docs.where(F.col("path").isin("same.5", "same.2", "same.6", "same.0")))
    docs.where(F.col("path").isin("same.1", "same.3", "same.4")).repartition(3).write.mode("append").parquet(inbox)
    run()
    compare(docs)


def test_a_batch_has_more_files_where_the_corpus_has_more_splits(spark, tmp_path):
    from docwarden.plans import chained as ch

    texts = spark.range(0, 400).selectExpr("'o/r' AS repo", "'d' || id AS path", "'/x/d' || id AS abs_path", "'text' AS content")
    for splits, want in ((1, 1), (4, 1), (16, 4), (18, 5)):
        inbox = str(tmp_path / f"inbox-{splits}")
        assert ch._deliver(as_docs(texts.repartition(splits)), inbox) == want
        written = spark.read.parquet(inbox)
        assert written.count() == 400 and len(written.inputFiles()) == 4 * want
