"""Deterministic rewrites.

Each fixer is an expression over the current text and its parsed metadata.  They run as one chain of
projections in the order of the rule scores, every fixer seeing the text the one before left.  Only
metadata blocks that a fixer changed are parsed again.  Text and findings come from the same row, so
the whole rewrite has no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import text as tx
from docwarden.functions.frontmatter import body_of, parse_block, present, with_frontmatter
from docwarden.functions.shaping import filter_once, inline_once
from docwarden.operators import audit as au
from docwarden.operators.rules import RuleSet, bad_version, no_heading
from docwarden.scratch import materialise

# What the fixers write.
DEFAULT_NAME = "Untitled Skill"
DEFAULT_ID = "untitled-skill"
DEFAULT_HEADING = "Skill"
STUB = '---\nid: "%s"\nname: "%s"\ndescription: "TODO: describe this skill."\nversion: "0.1.0"\ntags: []\n---\n'
VERSION_LINE = rf"(?d)\A((?s:.*?)(?m:^)version:(?U:{tx.WS}*)).+(?m:$)"
NEW_VERSION = '$1"0.1.0"'


@dataclass(frozen=True)
class Fixer:
    """``rewrite`` gives the new text, NULL for no change; ``edits_block`` says whether metadata may change."""

    rewrite: Callable[[], Column]
    edits_block: bool = True


def stub(content: Column) -> Column:
    """A minimal metadata block, named after the first heading."""
    name = F.coalesce(tx.first_heading(content), F.lit(DEFAULT_NAME))
    slug = F.coalesce(F.nullif(tx.kebab(name), F.lit("")), F.lit(DEFAULT_ID))
    before, between, after = STUB.split("%s")
    return F.concat(F.lit(before), slug, F.lit(between), name, F.lit(after))


def _add_block() -> Column:
    content = F.col("content")
    return F.when(~present(F.col("fm")), F.concat(stub(content), content))


def _kebab_id() -> Column:
    old = F.col("fm")["id"]["text"]
    new = tx.kebab(old)
    bare = tx.replace_first(F.col("content"), F.concat(F.lit("id: "), old), F.concat(F.lit("id: "), new))
    quote = lambda v: F.concat(F.lit('id: "'), v, F.lit('"'))
    return F.when(old != new, tx.replace_first(bare, quote(old), quote(new)))


def _reset_version() -> Column:
    return F.when(bad_version(F.col("fm")), F.regexp_replace(F.col("content"), VERSION_LINE, NEW_VERSION))


def _add_heading() -> Column:
    content, head, fm = F.col("content"), F.col("head"), F.col("fm")
    named = F.coalesce(fm["name"]["text"], F.lit(DEFAULT_HEADING))
    line = F.concat(F.lit("# "), named, F.lit("\n\n"))
    # A block that is a non-empty list or scalar has no name to offer; such documents are left alone.
    usable = ~present(fm) | (fm["kind"] == "map") | ~fm["truthy"]
    return F.when(usable & no_heading(body_of(content)), F.concat(head, line, tx.after_head(content, head)))


FIXERS: dict[str, Fixer] = {
    "FM001": Fixer(_add_block),
    "FM004": Fixer(_kebab_id),
    "FM005": Fixer(_reset_version),
    "ST001": Fixer(_add_heading, edits_block=False),
}


def register_fixer(rule_id: str, rewrite: Callable[[], Column], edits_block: bool = True) -> None:
    """Add a fixer: an expression over ``content``, ``head``, ``block`` and ``fm``."""
    FIXERS[rule_id] = Fixer(rewrite, edits_block)


def fixer_order(rules: RuleSet) -> list[str]:
    """Ids of the fixable rules that have a fixer, most urgent first."""
    usable = [r for r in rules.rules if r["fixable"] and r["id"] in FIXERS]
    return [r["id"] for r in sorted(usable, key=rules.urgency)]


def _apply(docs: DataFrame, rule_id: str) -> DataFrame:
    new = F.when(F.array_contains("wanted", rule_id), FIXERS[rule_id].rewrite())
    docs = docs.withColumn("_new", new)
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("content"))
    docs = docs.withColumn("_changed", changed)
    step = F.when(F.col("_changed"), F.array(F.lit(rule_id))).otherwise(F.array().cast("array<string>"))
    return docs.withColumns(
        {
            "content": F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("content")),
            "applied": F.concat("applied", step),
            "_stale": F.col("_stale") | F.col("_changed"),
        }
    ).drop("_new", "_changed")


def _reparse(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn(
        "_head", F.when(F.col("_stale"), tx.fence_head(F.col("content"))).otherwise(F.col("head"))
    ).withColumn("_block", tx.fence_block(F.col("_head")))
    same = F.col("_block").eqNullSafe(F.col("block"))
    docs = docs.withColumn("_fm", parse_block(F.when(~same, F.col("_block"))))
    return docs.withColumns(
        {
            "fm": F.when(same, F.col("fm")).otherwise(F.col("_fm")),
            "head": F.col("_head"),
            "block": F.col("_block"),
            "_stale": F.lit(False),
        }
    ).drop("_head", "_block", "_fm")


def _run_chain(docs: DataFrame, order: list[str], rounds: int = 0) -> DataFrame:
    """Apply the wanted fixers in ``order``; with ``rounds`` in each document's own, one of its fixers a round."""
    if rounds:
        docs = docs.withColumn("_each", F.col("wanted"))
    docs = docs.withColumns(
        {
            "content_before": F.col("content"),
            "applied": F.array().cast("array<string>"),
            "_stale": F.lit(False),
        }
    )
    stale = False
    for n, rule_id in enumerate(order * max(1, rounds)):
        if stale:
            docs = _reparse(docs)
        if rounds:
            docs = docs.withColumn("wanted", F.slice("_each", n // len(order) + 1, 1))
        docs = _apply(docs, rule_id)
        stale = FIXERS[rule_id].edits_block
    if stale or not order:
        docs = _reparse(docs)
    else:
        # The last fixer only moved the body, so the parsed metadata holds and the fence may have grown.
        docs = docs.withColumn("head", F.when(F.col("_stale"), tx.fence_head(F.col("content"))).otherwise(F.col("head")))
    return docs.withColumn("touched", F.size("applied") > 0).drop("_stale", "wanted", "_each")


def fix_audited(audited: DataFrame, rules: RuleSet) -> DataFrame:
    """Audited documents with ``content_before``, ``content``, ``applied`` (rule ids) and ``touched``."""
    fixable = F.filter("findings", lambda f: f["fixable"])
    wanted = F.transform(fixable, lambda f: f["rule_id"])
    docs = audited.withColumn("wanted", wanted).drop("body", "schema_errors")
    return _run_chain(docs, fixer_order(rules))


def _common_order(per_doc: DataFrame, ids: list[str]) -> list[str] | None:
    """An order of the fixers that agrees with that of every document, if there is one."""
    at = F.posexplode("wanted")
    first, then = (per_doc.select("doc_key", at.alias(f"{n}_at", n)) for n in ("a", "b"))
    pairs = first.join(then, "doc_key").where("a_at < b_at").select("a", "b").distinct().collect()  # at most fixers squared
    before = {i: {r["a"] for r in pairs if r["b"] == i} for i in ids}
    order: list[str] = []
    while len(order) < len(ids):
        free = [i for i in ids if i not in order and before[i] <= set(order)]
        if not free:
            return None
        order.append(free[0])
    return order


def fix_planned(items: DataFrame, docs: DataFrame, rules: RuleSet) -> DataFrame:
    """As :func:`fix_audited`, for a plan that was stored or edited since: joins its items to ``docs``.

    The plan decides: an item is fixed if it says ``fixable`` and there is a fixer, in the order of ``rank``
    (items without one come last, in rule order).  Per document the join carries a handful of rule ids; the text moves once.
    """
    usable = items.where(F.col("fixable") & F.col("rule_id").isin(*FIXERS) & (F.trim(F.col("abs_path")) != ""))
    ids = fixer_order(rules)
    ids += [i for i in FIXERS if i not in ids]
    place = F.element_at(F.create_map(*[F.lit(x) for k, i in enumerate(ids) for x in (i, k)]), F.col("rule_id"))
    rank = F.col("rank").cast("long") if "rank" in items.columns else F.lit(None).cast("long")
    step = F.struct(rank.isNull().alias("last"), rank.alias("rank"), place.alias("place"), "rule_id")
    steps = usable.groupBy("doc_key").agg(F.sort_array(F.collect_set(step)).alias("steps"))
    per_doc = steps.select("doc_key", F.array_distinct(F.transform("steps", lambda s: s["rule_id"])).alias("wanted"))
    per_doc = materialise(per_doc, "planned-fixes")
    joined = with_frontmatter(docs.join(per_doc, "doc_key")).drop("body")
    order = _common_order(per_doc, ids)
    return _run_chain(joined, order) if order is not None else _run_chain(joined, ids, len(ids))


def fix_actions(fixed: DataFrame, applied: bool = False) -> DataFrame:
    """One row per rewrite; ``step`` is its place in the document's chain."""
    steps = fixed.select("abs_path", "path", "repo", F.posexplode_outer("applied").alias("step", "rule_id"))
    return steps.where(F.col("step").isNotNull()).select(
        "abs_path",
        "path",
        "repo",
        "step",
        "rule_id",
        F.lit(applied).alias("applied"),
        F.concat(F.lit("Rule "), F.col("rule_id"), F.lit(" fix applied.")).alias("diff_summary"),
    )


def fixed_docs(fixed: DataFrame) -> DataFrame:
    """The rewritten documents, as a corpus."""
    return filter_once(fixed, F.col("touched")).select(
        *au.IDENTITY,
        "content",
        F.octet_length("content").cast("long").alias("size_bytes"),
        tx.content_hash(F.col("content")).alias("content_hash"),
    )


def reaudit(fixed: DataFrame, rules: RuleSet) -> DataFrame:
    """Audit of the touched documents; the findings before are in ``findings_before``."""
    before = [F.col("findings").alias("findings_before")] if "findings" in fixed.columns else []
    touched = filter_once(fixed, F.col("touched")).select(
        *au.IDENTITY, "content", "head", "block", "fm", tx.content_hash(F.col("content")).alias("content_hash"), *before
    )
    return au.audit_parsed(touched.withColumn("body", body_of(F.col("content"))), rules)


def fix_delta(reaudited: DataFrame) -> DataFrame:
    """Findings per rule on the touched documents, before and after."""
    tag = lambda column, b, a: F.transform(
        column, lambda f: F.struct(f["rule_id"].alias("rule_id"), F.lit(b).alias("before"), F.lit(a).alias("after"))
    )
    both = F.concat(tag("findings_before", 1, 0), tag("findings", 0, 1))
    return (
        inline_once(reaudited.select(both.alias("both")), "both")
        .groupBy("rule_id")
        .agg(F.sum("before").cast("long").alias("before"), F.sum("after").cast("long").alias("after"))
    )
