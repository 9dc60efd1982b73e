"""A corpus for training: toxic documents out, near copies out, repeated passages cut, leaks out, the rest encoded.

``STAGES`` are functions of ``(spark, docs, sf_dir)``; each takes all that the one before kept, written as Parquet
and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm.bpe import bpe_encode
from docwarden.llm.decontaminate import find_leaks
from docwarden.llm.jaccard import jaccard_groups
from docwarden.llm.queries import learned_from, vocabulary_path
from docwarden.llm.substring import remove_repeated_passages
from docwarden.llm.toxicity import fit_toxicity, score_toxicity
from docwarden.scratch import materialise

#: A document goes if its score is at least this.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below :data:`TOXIC`.

    The classifier learns from the labelled documents of the stage's input that are not in the held-out third.
    Documents without text or id are scored like all others.  Without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learned_from())
    model = fit_toxicity(docs.where(learned_from()), labels)
    cut = TOXIC if len(model.bucket) else 2.0
    return score_toxicity(docs, model, score="_score").where(F.col("_score") < cut).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; texts without words group with nothing.

    Rows that share an id are one document: if all of them would stay, one of them does.  Of the rows without
    an id those stay whose group has no document with one.
    """
    grouped = jaccard_groups(docs, size="_size", component="_component")
    kept = grouped.where(F.coalesce(F.col("doc_id") == F.col("_component"), F.col("_component").isNull())).select(*docs.columns)
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if shared.isEmpty():
        return kept
    named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id IS NULL"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occurred earlier; a document left without words goes.

    Documents that lose nothing keep their text as it is.  Those that had no words before stay.
    """
    cut = remove_repeated_passages(docs, kept="_kept")
    text = F.when(F.col("n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    chars = F.when(F.col("n_removed") > 0, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns({"_text": text, "_chars": chars}).select(*(F.col({"text": "_text", "n_chars": "_chars"}.get(c, c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items, leaks="_leaks").where(F.size("_leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and a digest of the text decoded from them."""
    out = bpe_encode(docs.select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"), F.col("bpe_ids").alias("ids"), F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: SQL has no form for the classifier and the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
