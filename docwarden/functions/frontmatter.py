"""Metadata blocks: YAML text in, one typed struct out, and back to YAML for relocated documents.

Only the block itself travels to Python (Arrow batches); the document text stays in the JVM.  The
struct can hold wrong types, because findings are made from them: every scalar is a *node*
``(kind, text, num, truthy)`` where ``text`` is Python's ``str()`` of the value.
"""

from __future__ import annotations

import datetime
import json
from typing import Any

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StringType, StructField, StructType

from docwarden.functions import text as tx
from docwarden.functions.shaping import inline_once
from docwarden.scratch import materialise

try:
    import yaml
except ImportError:  # only the two UDFs below need it
    yaml = None

SCALARS = ("id", "name", "description", "version", "verification", "source", "migrated_at")
ITEM_FIELDS = {"inputs": ("name", "type", "description", "required"), "outputs": ("name", "type", "description")}

_TEXT, _TEXTS = StringType(), ArrayType(StringType())


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_NODE = _struct(kind=_TEXT, text=_TEXT, num=DoubleType(), truthy=BooleanType())
_LIST = _struct(kind=_TEXT, text=_TEXT, truthy=BooleanType(), items=ArrayType(_NODE))


def _item_list(fields: tuple[str, ...]) -> StructType:
    item = _struct(kind=_TEXT, text=_TEXT, keys=_TEXTS, **{f: _NODE for f in fields})
    return _struct(kind=_TEXT, text=_TEXT, items=ArrayType(item))


FRONTMATTER_TYPE = _struct(
    kind=_TEXT,
    text=_TEXT,
    truthy=BooleanType(),
    keys=_TEXTS,
    **{f: _NODE for f in SCALARS},
    tags=_LIST,
    **{k: _item_list(v) for k, v in ITEM_FIELDS.items()},
    tooling=_struct(kind=_TEXT, text=_TEXT, models=_LIST, tools=_LIST, min_context_tokens=_NODE),
    json=_TEXT,
)


# Rows whose blocks are Python values at the same time.
PIECE = 512


def _need_yaml() -> None:
    if yaml is None:
        raise ImportError("PyYAML is needed on the executors to parse or render metadata blocks")


def load_yaml(block: str) -> tuple[bool, Any]:
    """``(valid, value)`` of one block.  The C parser answers first; what it refuses, the plain one decides."""
    for loader in (getattr(yaml, "CSafeLoader", None), yaml.SafeLoader):
        if loader is None:
            continue
        try:
            return True, yaml.load(block, Loader=loader)
        except (yaml.YAMLError, ValueError, OverflowError, RecursionError, TypeError):
            continue
    return False, None


def _clean(value: Any) -> str:
    s = str(value)
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def _kind(v: Any) -> str:
    if v is None:
        return "null"
    for types, name in (
        (bool, "bool"),
        (int, "int"),
        (float, "float"),
        (str, "string"),
        (datetime.datetime, "timestamp"),
        (datetime.date, "date"),
        (list, "list"),
        (dict, "map"),
        (set, "set"),
    ):
        if isinstance(v, types):
            return name
    return "other"


def _node(v: Any) -> dict:
    kind = _kind(v)
    num = None
    if kind in ("int", "float"):
        try:
            num = float(v)
        except OverflowError:
            num = float("inf") if v > 0 else float("-inf")
    return {"kind": kind, "text": _clean(v), "num": num, "truthy": bool(v)}


def _node_list(v: Any) -> dict:
    items = [_node(x) for x in v] if isinstance(v, list) else None
    return {"kind": _kind(v), "text": _clean(v), "truthy": bool(v), "items": items}


def _object_list(v: Any, fields: tuple[str, ...]) -> dict:
    items = None
    if isinstance(v, list):
        items = []
        for x in v:
            row: dict[str, Any] = {"kind": _kind(x), "text": _clean(x)}
            if isinstance(x, dict):
                row["keys"] = [_clean(k) for k in x]
                row.update((f, _node(x[f])) for f in fields if f in x)
            items.append(row)
    return {"kind": _kind(v), "text": _clean(v), "items": items}


def _tooling(v: Any) -> dict:
    row: dict[str, Any] = {"kind": _kind(v), "text": _clean(v)}
    if isinstance(v, dict):
        row.update((k, _node_list(v[k])) for k in ("models", "tools") if k in v)
        if "min_context_tokens" in v:
            row["min_context_tokens"] = _node(v["min_context_tokens"])
    return row


def _typed(block: str) -> dict | None:
    valid, data = load_yaml(block)
    if not valid:
        return None
    row: dict[str, Any] = {"kind": _kind(data), "truthy": bool(data)}
    if isinstance(data, dict):
        row["keys"] = [_clean(k) for k in data]
        row.update((f, _node(data[f])) for f in SCALARS if f in data)
        if "tags" in data:
            row["tags"] = _node_list(data["tags"])
        row.update((k, _object_list(data[k], v)) for k, v in ITEM_FIELDS.items() if k in data)
        if "tooling" in data:
            row["tooling"] = _tooling(data["tooling"])
    elif isinstance(data, (list, set)):
        row["keys"] = [_clean(x) for x in data if isinstance(x, str)]
        row["text"] = _clean(data)
    else:
        row["text"] = _clean(data)
    try:
        row["json"] = _clean(json.dumps(data, default=str, ensure_ascii=False))
    except (TypeError, ValueError):
        row["json"] = _clean(json.dumps(str(data)))
    return row


def _parse_udf(loads: Accumulator | None = None):
    arrow_type = to_arrow_type(FRONTMATTER_TYPE)

    @F.arrow_udf(FRONTMATTER_TYPE)
    def parse(blocks: pa.Array) -> pa.Array:
        _need_yaml()
        # Each distinct block once, in pieces: a batch has up to 10 000 rows, and as Python values they take a multiple.
        coded = blocks.dictionary_encode()
        parts = []
        for at in range(0, len(coded.dictionary), PIECE):
            piece = coded.dictionary.slice(at, PIECE)
            parts.append(pa.array([_typed(block) for block in piece.to_pylist()], type=arrow_type))
            if loads is not None:
                loads.add(len(piece))
        return pa.concat_arrays(parts).take(coded.indices) if parts else pa.nulls(len(blocks), arrow_type)

    # Not a matter of randomness: it keeps Catalyst from copying the call into several operators.
    return parse.asNondeterministic()


def parse_block(block: Column, loads: Accumulator | None = None) -> Column:
    """Typed struct of a metadata block; NULL for no block or invalid YAML, kind ``null`` for an empty one.

    Each task parses equal blocks of a batch once; ``loads`` counts what is parsed.
    """
    return _parse_udf(loads)(block)


def present(fm: Column) -> Column:
    """True where the document has metadata of any kind."""
    return fm["kind"].isNotNull() & (fm["kind"] != "null")


def with_frontmatter(docs: DataFrame, content: str = "content") -> DataFrame:
    """Add ``head`` (both fences and the block), ``block``, ``fm`` and ``body``."""
    return with_parsed(with_block(docs, content), content)


def with_block(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.withColumn("head", tx.fence_head(F.col(content))).withColumn("block", tx.fence_block(F.col("head")))


def with_parsed(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.withColumn("fm", parse_block(F.col("block"))).withColumn("body", body_of(F.col(content)))


# Parsed blocks that are sent to every task; more are joined by their key.
MAX_SHARED_BLOCKS = 20_000


def with_distinct_frontmatter(docs: DataFrame, content: str = "content", loads: Accumulator | None = None) -> DataFrame:
    """As :func:`with_frontmatter`, with every distinct block of the corpus parsed once.

    For corpora whose blocks repeat and are costly to parse.  Hashes of blocks are counted, partially before the
    shuffle; blocks that occur once are parsed where they are, the others once each, and their documents get
    the result by a join.  Few repeated blocks are broadcast, so that no text moves.
    """
    keyed = with_block(docs, content).withColumn("_key", F.sha2(F.col("block"), 256))
    named = keyed.select("_key", "block").where(F.col("block").isNotNull())
    repeated = materialise(named.groupBy("_key").count().where("count > 1").select("_key"), "repeated-blocks")
    few = repeated.count() <= MAX_SHARED_BLOCKS
    of_these = named.join(F.broadcast(repeated) if few else repeated, "_key", "left_semi").groupBy("_key").agg(F.first("block").alias("b"))
    parsed = materialise(of_these.select("_key", parse_block(F.col("b"), loads).alias("_fm"), F.lit(True).alias("_known")), "parsed-blocks")
    both = keyed.join(F.broadcast(parsed) if few else parsed, "_key", "left")
    single = both.withColumn("_own", parse_block(F.when(F.col("_known").isNull(), F.col("block")), loads))
    # At most one of the two is there, as no block was left to parse for documents of a known one.
    return single.withColumn("fm", F.coalesce("_fm", "_own")).withColumn("body", body_of(F.col(content))).drop("_key", "_fm", "_known", "_own")


def body_of(content: Column) -> Column:
    """Text after the fence; the whole text without a fence or with invalid YAML."""
    return F.when(F.col("fm")["kind"].isNotNull(), tx.after_head(content, F.col("head"))).otherwise(content)


_ENTRIES = ArrayType(_struct(key_path=_TEXT, kind=_TEXT, value=_TEXT))


def _walk(data: Any) -> list[dict]:
    """Keys and elements at any depth, in order; a value inside itself is shown as text and not entered again."""
    out: list[dict] = []
    todo: list[tuple[str, Any, frozenset]] = [("", data, frozenset())]
    while todo:
        path, v, above = todo.pop()
        if path:
            out.append({"key_path": path, "kind": _kind(v), "value": _clean(v)})
        inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        if id(v) not in above:
            within = above | {id(v)}
            todo += [(f"{path}.{_clean(k)}" if path else _clean(k), x, within) for k, x in inner][::-1]
    return out


def _entries_udf():
    arrow_type = to_arrow_type(_ENTRIES)

    @F.arrow_udf(_ENTRIES)
    def entries(blocks: pa.Array) -> pa.Array:
        _need_yaml()
        parts = [pa.array([], type=arrow_type)]
        for at in range(0, len(blocks), PIECE):
            rows = []
            for block in blocks.slice(at, PIECE).to_pylist():
                valid, data = load_yaml(block) if block is not None else (False, None)
                rows.append(_walk(data) if valid and data is not None else [])
            parts.append(pa.array(rows, type=arrow_type))
        return pa.concat_arrays(parts)

    return entries.asNondeterministic()


def frontmatter_long(docs: DataFrame) -> DataFrame:
    """One row per key and list element at any depth: ``(doc_key, key_path, kind, value)``.

    Path parts are keys, or places in lists; keys outside the schema are there like all others.
    """
    entries = docs.select("doc_key", _entries_udf()(F.col("block")).alias("entries"))
    return inline_once(entries, "entries", "doc_key")


def _render_udf():
    @F.arrow_udf("string")
    def render(blocks: pa.Array, ids: pa.Array, sources: pa.Array, stamps: pa.Array) -> pa.Array:
        _need_yaml()
        parts = [pa.array([], type=pa.string())]
        for at in range(0, len(blocks), PIECE):
            out = []
            for block, new_id, source, stamp in zip(*(x.slice(at, PIECE).to_pylist() for x in (blocks, ids, sources, stamps))):
                data = load_yaml(block)[1] if block is not None else None
                data = dict(data) if isinstance(data, dict) else {}
                if new_id is not None:
                    data["id"] = new_id
                data["source"] = source
                data["migrated_at"] = stamp
                out.append(yaml.dump(data, Dumper=yaml.SafeDumper, sort_keys=False, allow_unicode=True))
            parts.append(pa.array(out, type=pa.string()))
        return pa.concat_arrays(parts)

    return render.asNondeterministic()


def render_block(block: Column, new_id: Column, source: Column, stamp: Column) -> Column:
    """YAML of a block with ``id`` set (where given) and ``source`` and ``migrated_at`` stamped."""
    return _render_udf()(block, new_id, source, stamp)
