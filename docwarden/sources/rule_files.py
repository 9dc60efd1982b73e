"""Rule files: JSON or YAML lists of rules that overlay the built-in ones."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions.frontmatter import load_yaml
from docwarden.operators.rules import ATTRIBUTES, RuleSet, built_in, merge

# File names, in order of preference.
FILE_NAMES = ("rules.json", "rules.yaml", "rules.yml", "skills-best-practices.json")

_ENTRY = "struct<id:string,given:array<string>,name:string,severity:string,description:string,effort:string,fixable:boolean>"


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _entries(name: str, text: str) -> list[dict] | None:
    """Rules of one file; entries without an id are dropped, None means not a rule file."""
    if name.endswith((".yaml", ".yml")):
        valid, data = load_yaml(text)
        if not valid:
            return None
    else:
        try:
            data = json.loads(text)
        except ValueError:
            return None
    if isinstance(data, dict) and "rules" in data:
        data = data["rules"]
    if not isinstance(data, list):
        return None
    return [
        {
            "id": _text(e["id"]),
            "given": [a for a in ATTRIBUTES if a in e],
            "fixable": None if e.get("fixable") is None else bool(e["fixable"]),
            **{a: _text(e.get(a)) for a in ATTRIBUTES if a != "fixable"},
        }
        for e in data
        if isinstance(e, dict) and "id" in e
    ]


def _parse(name: Column, text: Column) -> Column:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, StructType

    kind = ArrayType(StructType.fromDDL(_ENTRY[7:-1]))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def parse(names: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_entries(n, t) for n, t in zip(names.to_pylist(), texts.to_pylist())], type=arrow)

    return parse.asNondeterministic()(name, text)


def rules_of_files(files: DataFrame) -> DataFrame:
    """Rules of ``files(location, name, text)``: per location the first name that holds a rule list.

    Gives ``(location, pos, id, given, name, severity, description, effort, fixable)``.
    """
    known = files.where(F.col("name").isin(*FILE_NAMES))
    order = F.array_position(F.array(*[F.lit(n) for n in FILE_NAMES]), F.col("name"))
    parsed = known.select("location", order.alias("preference"), _parse(F.col("name"), F.col("text")).alias("entries"))
    usable = parsed.where(F.col("entries").isNotNull())
    # At most one file per known name and location, so a group is never large.
    chosen = usable.groupBy("location").agg(F.min_by("entries", "preference").alias("entries"))
    return chosen.select("location", F.posexplode("entries").alias("pos", "e")).select("location", F.col("pos").cast("long").alias("pos"), "e.*")


def read_rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rules found in a folder (usually one file)."""
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.{json,yaml,yml}").text(folder)
    name = F.substring_index(F.input_file_name(), "/", -1)
    return rules_of_files(texts.select(F.lit(folder).alias("location"), name.alias("name"), F.col("value").alias("text")))


def fetch_rules(spark: SparkSession, folder: str | None = None, fetched_at: str = "", source_url: str | None = None, commit_sha: str = "N/A") -> RuleSet:
    """The rule table: built-in rules, overlaid with those in ``folder`` where it has any."""
    if folder is None:
        return RuleSet.baseline(fetched_at)
    external = read_rule_files(spark, folder)
    if external.isEmpty():
        return RuleSet(RuleSet.baseline().rules, source_url or folder, commit_sha, fetched_at, True)
    return RuleSet.of_table(
        merge(built_in(spark), external),
        source_url=source_url or folder,
        commit_sha=commit_sha,
        fetched_at=fetched_at,
        is_baseline=False,
    )
