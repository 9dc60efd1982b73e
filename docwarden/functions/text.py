"""Column functions on text, paths and repository names.

The Java patterns below behave like the same patterns in Python:

* ``(?d)`` makes ``\\n`` the only line end for ``.``, ``^`` and ``$``;
* ``(?U)`` makes ``\\s`` and ``\\d`` Unicode-aware, and :data:`WS` adds the four separators
  ``\\x1c-\\x1f`` that only Python counts as white space;
* ``(?iu)`` is Unicode case folding;
* word borders are spelled out with :data:`WORD`, since ``\\b`` differs between the two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"

# The characters str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

FENCE = rf"(?sdU)\A---{WS}*\n(.*?)\n---{WS}*\n"
HEADING = rf"(?mdU)^#{{1,6}}{WS}+{NOT_WS}"
HEADING_TEXT = rf"(?mdU)^#{{1,6}}{WS}+(.+)$"
KEBAB_ID = r"(?d)\A[a-z0-9]++(?:-[a-z0-9]++)*+$"
SEMVER = r"(?dU)\A\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$"


def normalise_text(raw: Column) -> Column:
    """Text from bytes (or a string): malformed UTF-8 becomes U+FFFD, every line end ``\\n``."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r\n?", "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def strip(text: Column) -> Column:
    """``str.strip()``: linear in the text, also on long runs of white space."""
    return F.trim(text, F.lit(PY_WHITESPACE))


def fence_head(content: Column) -> Column:
    """The opening fence, metadata block and closing fence, or ``''`` where there is none."""
    return F.when(F.startswith(content, F.lit("---")), F.regexp_extract(content, FENCE, 0)).otherwise("")


def fence_block(head: Column) -> Column:
    """The metadata block inside :func:`fence_head`; NULL without a fence."""
    return F.when(head != "", F.regexp_extract(head, FENCE, 1))


def after_head(content: Column, head: Column) -> Column:
    return F.substr(content, F.char_length(head) + 1)


def kebab(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def stable_id(repo: Column, path: Column) -> Column:
    """Identifier from repository and path; the extension is cut from the joined string."""
    joined = F.concat(F.replace(repo, F.lit("/"), F.lit("-")), F.lit("-"), path)
    return kebab(F.regexp_replace(joined, r"(?d)\.[^.]+$", ""))


def domain_of(tags: Column) -> Column:
    """Folder name from the first entry of a parsed tag list, else ``general``."""
    first = F.lower(F.get(tags["items"], 0)["text"])
    slug = F.trim(F.regexp_replace(first, "[^a-z0-9-]", "-"), F.lit("-"))
    usable = (tags["kind"] == "list") & (F.size(tags["items"]) > 0)
    return F.coalesce(F.when(usable, F.nullif(slug, F.lit(""))), F.lit("general"))


def first_heading(content: Column) -> Column:
    """Text of the first Markdown heading, stripped; NULL where there is none."""
    raw = F.regexp_extract(content, HEADING_TEXT, 1)
    return F.when(raw != "", strip(raw))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Literal replacement of the first occurrence only."""
    at = F.instr(text, old)
    swapped = F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.char_length(old)))
    return F.when(at > 0, swapped).otherwise(text)


def is_remote_url(spec: Column) -> Column:
    return spec.rlike(r"\A(?:https?://|git@)")


def repo_url(spec: Column) -> Column:
    """Clone address of a repository: ``owner/name`` is completed, all else stays."""
    short = F.contains(spec, F.lit("/")) & ~F.startswith(spec, F.lit("/")) & ~is_remote_url(spec)
    return F.when(short, F.concat(F.lit("https://github.com/"), spec, F.lit(".git"))).otherwise(spec)


def source_label(spec: Column) -> Column:
    """Display name of a repository."""
    tail = F.substring_index(F.rtrim(spec, F.lit("/")), "/", -1)
    whole = F.contains(spec, F.lit("/")) & ~is_remote_url(spec)
    return F.when(whole, strip(spec)).otherwise(F.replace(tail, F.lit(".git"), F.lit("")))


def tokenise(text: Column) -> Column:
    """Lower-cased words, split at white space."""
    return F.array_remove(F.split(F.lower(text), rf"(?U){WS}+"), "")
