from pyspark.sql import functions as F

from docwarden.functions.frontmatter import with_frontmatter
from docwarden.operators import audit as au
from docwarden.operators.rules import RuleSet
from docwarden.sources.corpus import as_docs

RULES = RuleSet.baseline(fetched_at="2024-01-01T00:00:00Z")

CLEAN = """---
id: "log-reader"
name: "Log Reader"
description: "Reads server logs and lists unusual entries."
version: "1.2.0"
tags: ["logs", "ops"]
inputs:
  - name: log
    type: string
    description: The log text.
    required: true
outputs:
  - name: report
    type: string
tooling:
  models: ["m1"]
  tools: []
  min_context_tokens: 2048
verification: "Run it on a log with one known fault."
---

# Log Reader

Give it a log. For example: yesterday's.
"""
BROKEN = '---\nid: "Log_Reader"\nname: ""\ndescription: "Too brief"\nversion: "v3"\ntags: []\n---\n'
PARTIAL = '---\nid: "half-done"\nname: "Half Done"\ndescription: "No version and no tags in here."\n---\n\nTwenty letters here.\n'
BARE = "# Plain notes without a block\n\nYou are a reader. Nothing else is said.\n"


def docs_of(spark, texts, repo="owner/repo"):
    rows = [(repo, f"d{i:03d}.md", f"/x/d{i:03d}.md", t) for i, t in enumerate(texts)]
    return as_docs(spark.createDataFrame(rows, "repo string, path string, abs_path string, content string"))


def audit_of(spark, texts, rules=RULES):
    return au.audit_docs(docs_of(spark, texts), rules)


def fired(audited):
    rows = audited.select("path", F.transform("findings", lambda f: f["rule_id"]).alias("r")).orderBy("path").collect()
    return [list(r["r"]) for r in rows]


def parsed_of(spark, texts):
    return with_frontmatter(docs_of(spark, texts))


def column_values(spark, values, make, kind="string"):
    """``make(column)`` for every value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select(make(F.col("v")).alias("out"), "i").orderBy("i").collect()]
