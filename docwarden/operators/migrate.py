"""Relocate documents to ``skills/<domain>/<id>.md``, with metadata stamps, pointers and collision checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import text as tx
from docwarden.functions.frontmatter import render_block
from docwarden.scratch import materialise

DEFAULT_REPO = "owner/library"  # target repository of pointer links, unless one is given
# Order in which documents are written; of several with one destination the last stays.
WRITE_ORDER = ("repo", "path", "abs_path")
# A destination with more sources than one in this many documents is joined map-side.
HOT_SHARE = 1000
FLAGS = ("applied", "deleted_source", "wrote_pointer")


def _url(repo: Column | str) -> Column:
    return F.concat(F.lit("https://github.com/"), F.lit(repo) if isinstance(repo, str) else repo)


def _blob(dest_rel: Column, skills_repo: str) -> Column:
    return F.concat(_url(skills_repo), F.lit("/blob/main/"), dest_rel)


def migrate_plan(parsed: DataFrame, skills_root: str = "skills") -> DataFrame:
    """Identity and destination of every document, text columns kept for rendering.

    Metadata that is neither a mapping nor empty cannot carry an id: ``status`` is then
    ``unsupported_frontmatter`` and the destination NULL.
    """
    fm = F.col("fm")
    usable = F.coalesce((fm["kind"] == "map") | (fm["kind"] == "null"), F.lit(True)) | (
        fm["kind"].isin("list", "string") & ~fm["truthy"]
    )
    kept = F.when(fm["id"]["truthy"], fm["id"]["text"])
    parent = skills_root.rstrip("/").rpartition("/")[0]
    prefix = parent + "/" if "/" in skills_root.rstrip("/") else ""
    return (
        parsed.where(F.trim(F.col("abs_path")) != "")
        .withColumn("status", F.when(usable, "ok").otherwise("unsupported_frontmatter"))
        .withColumn("new_id", F.when(kept.isNull(), tx.stable_id(F.col("repo"), F.col("path"))))
        .withColumn("skill_id", F.when(usable, F.coalesce(kept, F.col("new_id"))))
        .withColumn("domain", F.when(usable, tx.domain_of(fm["tags"])))
        .withColumn("dest_rel", F.concat(F.lit("skills/"), F.col("domain"), F.lit("/"), F.col("skill_id"), F.lit(".md")))
        .withColumn("dest_path", F.concat(F.lit(prefix), F.col("dest_rel")))
    )


def migrate_actions(
    planned: DataFrame,
    apply: bool = False,
    allow_delete: bool = False,
    dry_run: bool = True,
    write_pointer: bool = True,
) -> DataFrame:
    """What happens to each document.  Sources are deleted only where no pointer replaces them."""
    if allow_delete and not apply:
        raise ValueError("allow_delete needs apply")
    effective = apply and not dry_run
    ok = F.col("status") == "ok"
    return planned.select(
        "doc_key",
        "skill_id",
        "repo",
        "path",
        F.col("abs_path").alias("source_path"),
        "dest_path",
        "dest_rel",
        "domain",
        "status",
        (ok & F.lit(effective)).alias("applied"),
        (ok & F.lit(effective and allow_delete and not write_pointer)).alias("deleted_source"),
        (ok & F.lit(effective and write_pointer)).alias("wrote_pointer"),
    )


def migrate_outcomes(actions: DataFrame, copied: DataFrame, pointed: DataFrame, deleted: DataFrame) -> DataFrame:
    """``actions`` with their flags taken from what was really done: frames of the ``doc_key`` of each success."""
    each = [d.select("doc_key", *(F.lit(i == k).alias(c) for k, c in enumerate(FLAGS))) for i, d in enumerate((copied, deleted, pointed))]
    marks = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("doc_key").agg(*(F.max(c).alias(f"_{c}") for c in FLAGS))
    done = actions.join(marks, "doc_key", "left")
    return done.withColumns({c: F.coalesce(f"_{c}", F.lit(False)) for c in FLAGS}).select(*actions.columns)


def migrate_summary(actions: DataFrame) -> DataFrame:
    done = actions.where(F.col("status") == "ok")
    return done.agg(
        F.count("*").alias("total"),
        F.count_if("applied").alias("applied"),
        F.count_if("wrote_pointer").alias("pointers_written"),
        F.count_if("deleted_source").alias("deleted"),
    )


def migrate_rendered(planned: DataFrame, migrated_at: str) -> DataFrame:
    """The relocated documents with stamped metadata."""
    yaml_text = render_block(
        F.when(F.col("fm").isNotNull(), F.col("block")), F.col("new_id"), _url(F.col("repo")), F.lit(migrated_at)
    )
    return (
        planned.where(F.col("status") == "ok")
        .withColumn("_yaml", yaml_text)
        .withColumn("content", F.concat(F.lit("---\n"), F.col("_yaml"), F.lit("---\n"), F.col("body")))
        .select("doc_key", "repo", "path", "abs_path", "skill_id", "domain", "dest_rel", "dest_path", "content")
    )


# Fixed value: the stub, with places for the repository, the link and the identity.
POINTER = "<!-- This file was migrated to [{repo}]({link}). -->\n\n**Skill `{id}` has been migrated.**  \nSee: {link}\n"


def pointer_text(skill_id: Column, dest_rel: Column, skills_repo: str) -> Column:
    places = {"link": _blob(dest_rel, skills_repo), "id": skill_id, "repo": F.lit(skills_repo)}
    parts = re.split(r"\{(\w+)\}", POINTER)
    return F.concat(*[places[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def migrate_pointers(planned: DataFrame, skills_repo: str = DEFAULT_REPO) -> DataFrame:
    """Stubs that take the place of the sources."""
    text = pointer_text(F.col("skill_id"), F.col("dest_rel"), skills_repo)
    return planned.where(F.col("status") == "ok").select("doc_key", "repo", "path", "abs_path", text.alias("content"))


def migrate_collisions(planned: DataFrame) -> DataFrame:
    """Destinations with several sources: how many, and which document stays."""
    return (
        planned.where(F.col("status") == "ok")
        .groupBy("dest_rel")
        .agg(
            F.count("*").alias("n_sources"),
            F.max(F.struct(*WRITE_ORDER, "doc_key")).alias("last"),
        )
        .where("n_sources > 1")
        .select("dest_rel", "n_sources", F.col("last.doc_key").alias("kept_key"), F.col("last.abs_path").alias("kept"))
    )


def overwritten(planned: DataFrame) -> DataFrame:
    """Keys of the documents that a later one with the same destination replaces.

    Texts are parsed once, to write the keys down; only keys are shuffled.  Destinations that hold a large share of the documents are few by
    definition (fewer than ``HOT_SHARE``), so they are joined by broadcast; the rest is joined by key.
    """
    keys = materialise(planned.select("doc_key", "dest_rel", "status", *WRITE_ORDER), "destinations")
    keys = keys.where(F.col("status") == "ok")
    shared = migrate_collisions(keys).select("dest_rel", "n_sources", "kept_key")
    least = max(1000, keys.count() // HOT_SHARE)
    hot = F.broadcast(shared.where(F.col("n_sources") > least).drop("n_sources"))
    cold = shared.where(F.col("n_sources") <= least).drop("n_sources")
    loser = F.col("doc_key") != F.col("kept_key")
    in_hot = keys.select("doc_key", "dest_rel").join(hot, "dest_rel", "left").withColumnRenamed("kept_key", "hot_kept")
    of_hot = in_hot.where(F.col("doc_key") != F.col("hot_kept")).select("doc_key")
    of_cold = in_hot.where(F.col("hot_kept").isNull()).join(cold, "dest_rel").where(loser).select("doc_key")
    return of_hot.unionAll(of_cold)


def surviving(planned: DataFrame) -> DataFrame:
    """Documents that remain when all are written in order."""
    return planned.join(overwritten(planned), "doc_key", "left_anti")
