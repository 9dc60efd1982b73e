"""The metadata schema as a list of constraints, evaluated as one array column per document.

Every constraint looks at the parsed struct of :mod:`docwarden.functions.frontmatter` and yields a
``(path, keyword, message)`` entry when violated.  The constraints are listed in the order in which
errors are reported (by path; list elements by number), so no sort is needed at run time.  They are
written as SQL text, since some hundred small expressions are built much faster in one parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden.functions import text as tx
from docwarden.functions.frontmatter import ITEM_FIELDS
from docwarden.functions.shaping import sql_literal

# Required keys, in reporting order, and required keys of an input or output.
REQUIRED = ("id", "name", "description", "version", "tags")
ITEM_REQUIRED = ("name", "type")
# Shortest allowed texts, patterns and their wording.
MIN_LENGTH = {"name": 1, "description": 10}
PATTERNS = {
    "id": (tx.KEBAB_ID, "^[a-z0-9]+(-[a-z0-9]+)*$"),
    "version": (tx.SEMVER, r"^\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$"),
}
ERRORS_DDL = "array<struct<path:string,keyword:string,message:string>>"


def _shown(node: str) -> str:
    """The value as it appears in a message."""
    return f"CASE WHEN {node}.kind = 'string' THEN {_quoted(node)} ELSE {node}.text END"


def _quoted(node: str) -> str:
    quote = sql_literal("'")
    return f"concat({quote}, replace({node}.text, {quote}, {sql_literal(chr(92) + chr(39))}), {quote})"


def _error(broken: str, path: str, keyword: str, message: str) -> str:
    """``path`` and ``message`` are SQL; NULL where the constraint holds."""
    return f"CASE WHEN {broken} THEN named_struct('path', {path}, 'keyword', '{keyword}', 'message', {message}) END"


def _type(node: str, path: str, name: str, allowed: str) -> str:
    return _error(f"NOT ({allowed})", path, "type", f"concat({_shown(node)}, {sql_literal(f" is not of type '{name}'")})")


def _kind(node: str, path: str, name: str, kind: str) -> str:
    return _type(node, path, name, f"{node}.kind = '{kind}'")


def _min_length(node: str, path: str, least: int) -> str:
    said = " should be non-empty" if least == 1 else " is too short"
    short = f"{node}.kind = 'string' AND char_length({node}.text) < {least}"
    return _error(short, path, "minLength", f"concat({_quoted(node)}, {sql_literal(said)})")


def _pattern(node: str, name: str) -> str:
    pattern, wording = PATTERNS[name]
    said = " does not match '" + wording.replace("\\", "\\\\") + "'"
    return _error(
        f"{node}.kind = 'string' AND NOT {node}.text RLIKE {sql_literal(pattern)}",
        sql_literal(name),
        "pattern",
        f"concat({_quoted(node)}, {sql_literal(said)})",
    )


def _required(node: str, path: str, names: tuple[str, ...]) -> list[str]:
    return [
        _error(f"{node}.kind = 'map' AND NOT array_contains({node}.keys, '{n}')", path, "required", sql_literal(f"'{n}' is a required property"))
        for n in names
    ]


def _each(items: str, checks: list[str]) -> str:
    """Errors of all list elements, in order; ``checks`` speak of ``x`` and its place ``i``."""
    return f"coalesce(flatten(transform({items}, (x, i) -> array({', '.join(checks)}))), array())"


def _place(stem: str, field: str = "") -> str:
    return f"concat('{stem}.', i, '{field}')"


def _strings(node: str, stem: str, least: int | None = None) -> str:
    checks = [_kind("x", _place(stem), "string", "string")]
    if least:
        checks.append(_min_length("x", _place(stem), least))
    return _each(f"{node}.items", checks)


def _objects(node: str, stem: str) -> str:
    checks = [_kind("x", _place(stem), "object", "map"), *_required("x", _place(stem), ITEM_REQUIRED)]
    for field in sorted(ITEM_FIELDS[stem]):
        name, kind = ("boolean", "bool") if field == "required" else ("string", "string")
        checks.append(_kind(f"x.{field}", _place(stem, "." + field), name, kind))
    return _each(f"{node}.items", checks)


def _scalar(fm: str, name: str) -> list[str]:
    node = f"{fm}.{name}"
    checks = [_kind(node, sql_literal(name), "string", "string")]
    if name in PATTERNS:
        checks.append(_pattern(node, name))
    if name in MIN_LENGTH:
        checks.append(_min_length(node, sql_literal(name), MIN_LENGTH[name]))
    return checks


def errors_sql(fm: str) -> str:
    """SQL of all violations found in the struct column ``fm``."""
    tags, tooling = f"{fm}.tags", f"{fm}.tooling"
    tokens = f"{tooling}.min_context_tokens"
    integral = f"{tokens}.kind = 'int' OR ({tokens}.kind = 'float' AND {tokens}.num = floor({tokens}.num))"
    # Equal for equal values: numbers by value, truth values apart from numbers.
    keys = (
        f"transform({tags}.items, x -> CASE WHEN x.kind IN ('int', 'float') THEN concat('number:', x.num)"
        " ELSE concat(x.kind, ':', x.text) END)"
    )
    root = [
        _error(f"{fm}.kind <> 'map'", "'(root)'", "type", f"concat({_shown(fm)}, {sql_literal(" is not of type 'object'")})"),
        *_required(fm, "'(root)'", REQUIRED),
    ]
    tag_list = [
        _kind(tags, "'tags'", "array", "list"),
        _error(f"size({tags}.items) = 0", "'tags'", "minItems", "'[] should be non-empty'"),
        _error(f"size(array_distinct({keys})) < size({keys})", "'tags'", "uniqueItems", f"concat({tags}.text, ' has non-unique elements')"),
    ]
    tool = [
        _kind(tooling, "'tooling'", "object", "map"),
        _type(tokens, "'tooling.min_context_tokens'", "integer", integral),
        _error(f"{tokens}.num < 0", "'tooling.min_context_tokens'", "minimum", f"concat({tokens}.text, ' is less than the minimum of 0')"),
        _kind(f"{tooling}.models", "'tooling.models'", "array", "list"),
    ]
    parts = [
        [*root, *_scalar(fm, "description"), *_scalar(fm, "id"), _kind(f"{fm}.inputs", "'inputs'", "array", "list")],
        _objects(f"{fm}.inputs", "inputs"),
        [*_scalar(fm, "migrated_at"), *_scalar(fm, "name"), _kind(f"{fm}.outputs", "'outputs'", "array", "list")],
        _objects(f"{fm}.outputs", "outputs"),
        [*_scalar(fm, "source"), *tag_list],
        _strings(tags, "tags", 1),
        tool,
        _strings(f"{tooling}.models", "tooling.models"),
        [_kind(f"{tooling}.tools", "'tooling.tools'", "array", "list")],
        _strings(f"{tooling}.tools", "tooling.tools"),
        [*_scalar(fm, "verification"), *_scalar(fm, "version")],
    ]
    arrays = ", ".join(p if isinstance(p, str) else f"array({', '.join(p)})" for p in parts)
    return f"CASE WHEN {fm}.kind <> 'null' THEN array_compact(concat({arrays})) ELSE CAST(array() AS {ERRORS_DDL}) END"


def schema_errors(fm: str = "fm") -> Column:
    """All violations of one document; an empty array for valid or absent metadata."""
    return F.expr(errors_sql(fm))


def missing_sql(fm: str) -> str:
    """SQL of the required keys a mapping lacks, sorted."""
    return f"array_sort(array_except(array({', '.join(sql_literal(k) for k in REQUIRED)}), {fm}.keys))"


def missing_fields(fm: str = "fm") -> Column:
    return F.expr(missing_sql(fm))
