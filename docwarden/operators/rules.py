"""The rule table: built-in rules, overrides from outside, scores, and the test behind each rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import schema
from docwarden.functions import text as tx
from docwarden.functions.frontmatter import present

# Id, name, severity, description, effort, fixable of the built-in rules, in order.
BUILT_IN = (
    ("FM001", "missing-frontmatter", "error", "Skill file has no YAML frontmatter block.", "low", True),
    ("FM002", "invalid-frontmatter-schema", "error", "YAML frontmatter does not match the skill schema.", "low", False),
    ("FM003", "missing-required-field", "error", "A required frontmatter field is absent or empty.", "low", False),
    ("FM004", "non-kebab-id", "warning", "Skill `id` is not in lower-kebab-case format.", "low", True),
    ("FM005", "invalid-semver", "warning", "Skill `version` does not follow semver (MAJOR.MINOR.PATCH).", "low", True),
    ("CT001", "no-description", "warning", "Skill body contains no descriptive text below the frontmatter.", "medium", False),
    ("CT002", "no-usage-example", "info", "Skill body contains no usage example or sample prompt.", "medium", False),
    ("CT003", "missing-verification", "info", "Frontmatter lacks a `verification` guidance field.", "low", False),
    ("CT004", "missing-tags", "warning", "Skill has no taxonomy tags.", "low", False),
    ("ST001", "heading-missing", "info", "Skill body has no Markdown heading.", "low", True),
)
ATTRIBUTES = ("name", "severity", "description", "effort", "fixable")

# Order of severities, cost of efforts, risk by (fixable, effort), and advice by rule.
SEVERITY_ORDER = {"error": 0, "warning": 1, "info": 2}
UNKNOWN_SEVERITY = 2
EFFORT_COST = {"low": 1, "medium": 2, "high": 3, "unknown": 2}
UNKNOWN_EFFORT = 2
RISK = {
    "fixable/low": "low",
    "fixable/medium": "medium",
    "fixable/high": "high",
    "manual/low": "medium",
    "manual/medium": "high",
    "manual/high": "high",
}
UNKNOWN_RISK = "medium"
ADVICE = {
    "FM001": "Add YAML frontmatter block with required fields.",
    "FM002": "Fix frontmatter to match the skill schema.",
    "FM003": "Add missing required frontmatter fields.",
    "FM004": "Rename `id` to lower-kebab-case (e.g. `my-skill`).",
    "FM005": "Update `version` to semver format (e.g. `1.0.0`).",
    "CT001": "Add descriptive body text explaining the skill.",
    "CT002": "Add a usage example or sample prompt.",
    "CT003": "Add a `verification` field to frontmatter.",
    "CT004": "Add at least one tag to the `tags` array.",
    "ST001": "Add a Markdown heading (e.g. `# Skill Name`) to the body.",
}
OTHER_ADVICE = "Review and address the finding."
# What counts as a usage example, and how short a body is too short.
EXAMPLE_MARKS = ("example", "usage", "sample", "e.g.", "```")
SHORTEST_BODY = 20

RULES_DDL = "ord long, id string, name string, severity string, description string, effort string, fixable boolean"


# ---------------------------------------------------------------------------------------------
# Tests


@dataclass(frozen=True)
class Doc:
    """The columns a rule test can look at."""

    content: Column
    body: Column
    fm: Column
    errors: Column

    @classmethod
    def of_row(cls) -> Doc:
        return cls(F.col("content"), F.col("body"), F.col("fm"), F.col("schema_errors"))


def _is_map(fm: Column) -> Column:
    return fm["kind"] == "map"


def no_heading(body: Column) -> Column:
    return ~body.rlike(tx.HEADING)


def bad_version(fm: Column) -> Column:
    return ~fm["version"]["text"].rlike(tx.SEMVER)


def _no_example(body: Column) -> Column:
    lower = F.lower(body)
    found = F.lit(False)
    for mark in EXAMPLE_MARKS:
        found = found | F.contains(lower, F.lit(mark))
    return ~found


def _unverified(fm: Column) -> Column:
    named = F.array_contains(fm["keys"], "verification")
    return (
        F.when(_is_map(fm), F.coalesce(~fm["verification"]["truthy"], F.lit(True)))
        .when(fm["kind"].isin("list", "set"), ~named)
        .when(fm["kind"] == "string", ~F.contains(fm["text"], F.lit("verification")))
    )


def _untagged(fm: Column) -> Column:
    return _is_map(fm) & F.coalesce((fm["tags"]["kind"] != "list") | (F.size(fm["tags"]["items"]) == 0), F.lit(True))


CHECKS: dict[str, Callable[[Doc], Column]] = {
    "FM001": lambda d: ~present(d.fm),
    "FM002": lambda d: F.size(d.errors) > 0,
    "FM003": lambda d: _is_map(d.fm) & (F.size(schema.missing_fields("fm")) > 0),
    "FM004": lambda d: ~d.fm["id"]["text"].rlike(tx.KEBAB_ID),
    "FM005": lambda d: bad_version(d.fm),
    "CT001": lambda d: F.char_length(tx.strip(d.body)) < SHORTEST_BODY,
    "CT002": lambda d: _no_example(d.body),
    "CT003": lambda d: _unverified(d.fm),
    "CT004": lambda d: _untagged(d.fm),
    "ST001": lambda d: no_heading(d.body),
}


def register_rule(rule_id: str, check: Callable[[Doc], Column]) -> None:
    """Add (or replace) the test of a rule; NULL counts as not fired."""
    CHECKS[rule_id] = check


def fires(rule_id: str, doc: Doc | None = None) -> Column:
    return F.coalesce(CHECKS[rule_id](doc or Doc.of_row()), F.lit(False))


# ---------------------------------------------------------------------------------------------
# Rule table


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(BUILT_IN)], RULES_DDL)


def merge(base: DataFrame, external: DataFrame) -> DataFrame:
    """Overlay external rules on ``base``.

    ``external`` has ``(pos, id, given, name, severity, description, effort, fixable)``, where
    ``given`` lists the attributes an entry states.  An entry with a known id replaces the whole
    rule in its place; new ids follow in the order of their first entry; of several entries with
    one id the last counts.  Attributes an entry does not state take the defaults, not the values of
    the rule it replaces.
    """
    row = F.struct("given", *ATTRIBUTES)
    last = (
        external.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("pos").alias("first_pos"), F.max_by(row, F.col("pos")).alias("x"))
    )
    defaults = {"name": F.col("id"), "severity": F.lit("info"), "description": F.lit(""), "effort": F.lit("unknown"), "fixable": F.lit(False)}
    joined = base.join(last, "id", "full_outer")
    replaced = F.col("x").isNotNull()
    picked = [
        F.when(replaced & F.array_contains(F.col("x")["given"], a), F.col("x")[a])
        .when(replaced, defaults[a])
        .otherwise(F.col(a))
        .alias(a)
        for a in ATTRIBUTES
    ]
    # New ids sort behind every id of the base table.
    order = F.coalesce(F.col("ord"), F.lit(1 << 40) + F.col("first_pos")).alias("ord")
    return joined.select(order, "id", *picked)


def _pick(values: dict[str, Any], key: Column, default: Any) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def priority_score(severity: Column, effort: Column, fixable: Column) -> Column:
    """Lower is more urgent: severity first, then effort, then whether a fix is at hand."""
    by_hand = F.when(fixable, 0.0).otherwise(0.5)
    return (
        _pick(SEVERITY_ORDER, severity, UNKNOWN_SEVERITY) * 10 + _pick(EFFORT_COST, effort, UNKNOWN_EFFORT) + by_hand
    ).cast("double")


def risk(effort: Column, fixable: Column) -> Column:
    return _pick(RISK, F.concat(F.when(fixable, "fixable/").otherwise("manual/"), effort), UNKNOWN_RISK)


def advice(rule_id: Column) -> Column:
    return _pick(ADVICE, rule_id, OTHER_ADVICE)


def with_scores(rules: DataFrame, id_column: str = "id") -> DataFrame:
    """Add ``score``, ``risk`` and ``action`` to rules or findings."""
    return rules.select(
        "*",
        priority_score(F.col("severity"), F.col("effort"), F.col("fixable")).alias("score"),
        risk(F.col("effort"), F.col("fixable")).alias("risk"),
        advice(F.col(id_column)).alias("action"),
    )


@dataclass(frozen=True)
class RuleSet:
    """The rules of a table that have a test, and where the table came from.

    Rules without a test find nothing; of those only the number is known here, and ``full`` has their rows.
    """

    rules: tuple[dict[str, Any], ...]
    source_url: str = "(built-in)"
    commit_sha: str = "N/A"
    fetched_at: str = ""
    is_baseline: bool = True
    full: DataFrame | None = None
    count: int | None = None
    by_id: dict[str, dict[str, Any]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_id", {r["id"]: r for r in self.rules})

    @classmethod
    def of_table(cls, rules: DataFrame, **origin: Any) -> RuleSet:
        # As many rows as there are registered tests, however long the table is.
        rows = rules.where(F.col("id").isin(*CHECKS)).orderBy("ord").collect()
        return cls(tuple(r.asDict() for r in rows), full=rules, count=rules.count(), **origin)

    @classmethod
    def baseline(cls, fetched_at: str = "") -> RuleSet:
        names = ("id", *ATTRIBUTES)
        return cls(tuple({"ord": i, **dict(zip(names, r))} for i, r in enumerate(BUILT_IN)), fetched_at=fetched_at)

    def table(self, spark: SparkSession) -> DataFrame:
        names = ("ord", "id", *ATTRIBUTES)
        if self.full is not None:
            return self.full.select(*names)
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rules], RULES_DDL)

    def provenance(self) -> dict[str, Any]:
        return {
            "source_url": self.source_url,
            "commit_sha": self.commit_sha,
            "fetched_at": self.fetched_at,
            "is_baseline": self.is_baseline,
            "rule_count": len(self.rules) if self.count is None else self.count,
        }

    def urgency(self, rule: dict[str, Any]) -> tuple[float, int]:
        """Sort key of one fetched rule: :func:`priority_score` and its place in the table."""
        severity = SEVERITY_ORDER.get(rule["severity"], UNKNOWN_SEVERITY)
        effort = EFFORT_COST.get(rule["effort"], UNKNOWN_EFFORT)
        return severity * 10 + effort + (0.0 if rule["fixable"] else 0.5), rule["ord"]

    def checked(self) -> list[dict[str, Any]]:
        """The rules that have a test, in table order; others are skipped."""
        return [r for r in self.rules if r["id"] in CHECKS]
