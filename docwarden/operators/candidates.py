"""Which documents of a corpus are worth auditing: filters on paths and signals in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import text as tx
from docwarden.functions.frontmatter import present, with_frontmatter
from docwarden.functions.shaping import filter_once

# File name suffixes, skipped folders and the patterns of the three kinds of signal.
EXTENSIONS = (".md", ".markdown", ".txt", ".prompt", ".skill")
IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")
NAME_SIGNAL = r"(?iu)prompt|skill|instruction|system[-_]?message|template"
DIR_SIGNAL = r"(?iu)(?:prompts?|skills?|instructions?|templates?|agents?|ai|copilot|llm)(?=\n?(?:/|\z))"
CONTENT_SIGNALS = {
    "fence": rf"(?mdU)^---{tx.WS}*\n",
    "you_are": rf"(?iu)(?<!{tx.WORD})you are(?!{tx.WORD})",
    "system_prompt": rf"(?iu)(?<!{tx.WORD})system prompt(?!{tx.WORD})",
    "instruction": rf"(?iu)(?<!{tx.WORD})instruction(?!{tx.WORD})",
    "act_as": rf"(?iu)(?<!{tx.WORD})act as(?!{tx.WORD})",
    "template_variable": rf"(?d)(?<={tx.WORD})\{{\{{.*?\}}\}}(?={tx.WORD})",
    "placeholder": r"\{[A-Z_]+\}",
}
ENOUGH_SIGNALS = 2


# Suffixes in any case, as a pattern of file names.
TEXT_GLOB = "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS) + "}"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for names that only start or end with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def has_text_extension(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def in_ignored_dir(path: Column) -> Column:
    """True where a folder of a relative path is one of the skipped ones."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def name_signal(path: Column) -> Column:
    return file_name(path).rlike(NAME_SIGNAL)


def dir_signal(path: Column) -> Column:
    """True where any part of the path, the file name included, ends like a prompt folder."""
    return path.rlike(DIR_SIGNAL)


def content_signals(content: Column) -> Column:
    """How many of the content signals occur; each counts once."""
    total = F.lit(0)
    for pattern in CONTENT_SIGNALS.values():
        total = total + content.rlike(pattern).cast("int")
    return total


def is_candidate(path: Column, content: Column | None = None) -> Column:
    """The cheap tests on the path come first; the text is searched only where they do not decide."""
    by_text = F.lit(False) if content is None else content_signals(content) >= ENOUGH_SIGNALS
    return (
        F.when(~has_text_extension(path), False)
        .when(name_signal(path) | dir_signal(path), True)
        .otherwise(by_text)
    )


def candidates(docs: DataFrame, path_scope: str = "absolute") -> DataFrame:
    """Candidate documents of a corpus.

    ``path_scope`` says which path the folder signal looks at: ``absolute`` counts the parents of
    the scanned root, ``relative`` only what lies below it.
    """
    if path_scope not in ("absolute", "relative"):
        raise ValueError("path_scope is 'absolute' or 'relative'")
    looked_at = F.col("abs_path" if path_scope == "absolute" else "path")
    by_path = docs.where(~in_ignored_dir(F.col("path")) & has_text_extension(looked_at))
    return filter_once(by_path, is_candidate(looked_at, F.col("content")))


def describe(docs: DataFrame) -> DataFrame:
    """The manifest entries of candidate documents."""
    return with_frontmatter(docs).select(
        "repo",
        "path",
        "abs_path",
        "content_hash",
        present(F.col("fm")).alias("has_frontmatter"),
        F.when(present(F.col("fm")) & F.col("fm")["truthy"], F.col("fm")["json"]).otherwise("{}").alias("frontmatter"),
        "size_bytes",
    )
