"""A corpus with metadata blocks, derived from a plain ``documents`` table.

The table's texts carry no metadata, so each row gets a repository, a path and one of sixteen kinds
of block from its number.  The expressions use only what Spark SQL and ANSI engines share, so the
same text defines the corpus on both sides of a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from docwarden.sources.corpus import as_docs

_N = "CAST(doc_id AS STRING)"
_NL = "chr(10)"


def _case(modulus: int, branches: dict[int, str], default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items())
    return f"(CASE doc_id % {modulus} {whens} ELSE {default} END)"


REPO = "('owner/' || source)"
PATH = _case(
    7,
    {
        0: f"'prompts/doc-' || {_N} || '.md'",
        1: f"'notes/doc-' || {_N} || '.md'",
        2: f"'.github/skills/doc-' || {_N} || '.txt'",
        3: f"'node_modules/pkg/prompt-' || {_N} || '.md'",
        4: f"'src/chai/doc-' || {_N} || '.markdown'",
        5: f"'img/prompt-' || {_N} || '.png'",
    },
    f"'docs/My Skill ' || {_N} || '.MD'",
)
_ID = _case(16, {3: f"'id: BadID_' || {_N}", 4: f"'id: \"Bad ID ' || {_N} || '\"'"}, f"'id: doc-' || {_N}")
_DESCRIPTION = _case(16, {8: "'Too short'"}, f"'Synthetic document number ' || {_N}")
_VERSION = _case(16, {5: "'v2'", 6: "'1.0'"}, "'1.' || CAST(doc_id % 5 AS STRING) || '.0'")
_TAGS = _case(16, {7: "'[]'", 13: "'[' || lang || ', ' || lang || ']'"}, "'[' || lang || ', ' || source || ']'")
_EXTRA = _case(16, {1: f"'verification: Check it.' || {_NL}", 11: f"'verification: \"\"' || {_NL}"}, "''")
_VERSION_TAGS = _case(16, {2: "''"}, f"'version: ' || {_VERSION} || {_NL} || 'tags: ' || {_TAGS} || {_NL}")
_BLOCK = (
    f"('---' || {_NL} || {_ID} || {_NL} || 'name: Doc ' || {_N} || {_NL} || 'description: ' || {_DESCRIPTION} || {_NL}"
    f" || {_VERSION_TAGS} || {_EXTRA} || '---')"
)
_BODY = f"({_NL} || '# Doc ' || {_N} || {_NL} || {_NL} || text || {_NL} || {_NL} || 'Example: run it.' || {_NL})"
_WHOLE = f"{_BLOCK} || {_NL} || {_BODY}"
CONTENT = _case(
    16,
    {
        0: "text",
        9: f"{_BLOCK} || {_NL} || text",
        10: f"{_BLOCK} || {_NL}",
        12: _BLOCK,
        14: f"replace({_WHOLE}, {_NL}, chr(13) || {_NL})",
        15: f"'# Title ' || {_N} || {_NL} || {_NL} || 'You are a helper. Act as a reviewer.' || {_NL} || {_NL} || text",
    },
    _WHOLE,
)
ABS_PATH = f"('/corpus/' || {REPO} || '/' || {PATH})"
SELECT = (
    f"SELECT doc_id, {REPO} AS repo, {PATH} AS path, {ABS_PATH} AS abs_path, {CONTENT} AS content FROM documents"
)


def raw_corpus(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "doc_id", f"{REPO} AS repo", f"{PATH} AS path", f"{ABS_PATH} AS abs_path", f"{CONTENT} AS content"
    )


def sample_corpus(documents: DataFrame) -> DataFrame:
    return as_docs(raw_corpus(documents))
