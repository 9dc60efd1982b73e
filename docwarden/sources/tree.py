"""Directory trees as a Spark data source: ``spark.read.format("document_tree")``.

Options: ``roots``, a JSON list of ``[repo, root]`` pairs; ``chunks``, about how many partitions to make; ``content``
(default true), whether files are opened at all.  Rows are ``repo, path, abs_path, suffix, size_bytes, content``.

The driver looks at the upper folders only, until there are enough of them to give every partition some; it never sees
a file's name.  A partition is a folder with or without what lies below it, or a share of that by the hash of the
path, so a folder that holds everything is shared by all tasks.  Tasks list (hidden names as well) and read.

Pushed down: comparisons of ``suffix`` and ``repo`` with values, prefixes and ends of ``path`` and comparisons of
``size_bytes``.  Folders outside a wanted prefix are not entered, and no file is opened that a filter drops.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from docwarden.operators.candidates import IGNORED_DIRS
from docwarden.sources.files import OUT_OF_REACH, READ_BYTES, entries, file_size, read_bytes

NAME = "document_tree"
SCHEMA = "repo string, path string, abs_path string, suffix string, size_bytes long, content binary"
#: Rows of a batch at most.
BATCH_ROWS = 4096
_PUSHED = {
    "repo": (ds.EqualTo, ds.In, ds.StringStartsWith),
    "suffix": (ds.EqualTo, ds.In),
    "path": (ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith),
    "size_bytes": (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual),
}
_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v,
    ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
}


def suffix(name: str) -> str:
    """Lower-case suffix with its dot; empty for names that only start or end with a dot."""
    at = name.rfind(".")
    return name[at:].lower() if 0 < at < len(name) - 1 else ""


@dataclass
class Chunk(ds.InputPartition):
    """Folders of one source, with all below them or without, and which share of their files."""

    repo: str
    root: str
    folders: list[str]
    deep: bool
    share: int
    shares: int

    def __post_init__(self) -> None:
        super().__init__(None)


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [(str(repo), str(root)) for repo, root in json.loads(options.get("roots", "[]"))]
        self.chunks = max(1, int(options.get("chunks", "32")))
        self.content = options.get("content", "true").lower() == "true"
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if isinstance(f, ds.IsNotNull) and column in (*_PUSHED, "abs_path"):
                continue  # never null
            if type(f) in _PUSHED.get(column, ()) and f.value is not None:
                value = frozenset(f.value) if isinstance(f, ds.In) else f.value
                self.pushed.append((column, type(f), value))
            else:
                yield f

    def _keeps(self, column: str, value: object) -> bool:
        return all(_TESTS[kind](value, wanted) for c, kind, wanted in self.pushed if c == column)

    def _may_hold(self, place: str) -> bool:
        """Whether files below the folder ``place`` (relative to its root) can have a wanted path."""
        inside = place + "/" if place else ""
        for column, kind, wanted in self.pushed:
            if column == "path" and kind is not ds.StringEndsWith:
                starts = wanted if kind is ds.In else (wanted,)
                if not any(str(w).startswith(inside) or (kind is ds.StringStartsWith and inside.startswith(str(w))) for w in starts):
                    return False
        return True

    def _folders(self, root: str, folder: str) -> Iterator[str]:
        """Folders right below one, without those that are skipped or out of question."""
        for path, is_dir in entries(folder):
            if is_dir and path.rsplit("/", 1)[-1] not in IGNORED_DIRS and self._may_hold(path[len(root) + 1 :]):
                yield path

    def partitions(self) -> list[ds.InputPartition]:
        roots = [(repo, root) for repo, root in self.roots if self._keeps("repo", repo)]
        deep = [(repo, root, root) for repo, root in roots]  # folders to be taken with all below them
        flat: list[tuple[str, str, str]] = []  # folders already looked into
        while deep and len(deep) < self.chunks:
            below = []
            for at, (repo, root, folder) in enumerate(deep):
                flat.append((repo, root, folder))
                below += [(repo, root, f) for f in self._folders(root, folder)]
                if len(below) + len(deep) - at - 1 >= 4 * self.chunks:  # wide enough; the others stay whole
                    below += deep[at + 1 :]
                    break
            deep = below
        return [*self._dealt(flat, False), *self._dealt(deep, True)] or [Chunk("", "", [], False, 0, 1)]

    def _dealt(self, folders: list[tuple[str, str, str]], deep: bool) -> list[Chunk]:
        """Several folders of one source a chunk, or several chunks a folder where there are few."""
        out: list[Chunk] = []
        sources = sorted({f[:2] for f in folders})
        for repo, root in sources:
            mine = [f[2] for f in folders if f[:2] == (repo, root)]
            want = max(1, self.chunks // len(sources))
            groups = [g for g in (mine[i::want] for i in range(want)) if g]
            shares = max(1, -(-want // len(groups)))
            out += [Chunk(repo, root, g, deep, i, shares) for g in groups for i in range(shares)]
        return out

    def _files(self, chunk: Chunk) -> Iterator[tuple[str, str]]:
        todo = list(chunk.folders)
        while todo:
            for path, is_dir in entries(todo.pop()):
                name = path.rsplit("/", 1)[-1]
                place = path[len(chunk.root) + 1 :]
                if is_dir:
                    if chunk.deep and name not in IGNORED_DIRS and self._may_hold(place):
                        todo.append(path)
                elif chunk.shares == 1 or zlib.crc32(place.encode("utf-8", "surrogateescape")) % chunk.shares == chunk.share:
                    if self._keeps("suffix", suffix(name)) and self._keeps("path", place):
                        yield path, place

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("abs_path", pa.string()), ("suffix", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])
        held: list[tuple] = []
        size = 0
        by_size = any(c == "size_bytes" for c, _, _ in self.pushed)
        for path, place in self._files(partition):
            content, length = None, None
            try:
                if by_size or not self.content:
                    length = file_size(path)
                    if length is None or not self._keeps("size_bytes", length):
                        continue
                if self.content:
                    content = read_bytes(path)
                    if content is None:
                        continue
                    length = len(content)
            except OUT_OF_REACH:
                continue
            held.append((partition.repo, place, path, suffix(place.rsplit("/", 1)[-1]), length, content))
            size += length if self.content else 0
            if len(held) >= BATCH_ROWS or size >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class DocumentTree(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, roots: list[tuple[str, str]], wanted: Column | None = None, content: bool = True, chunks: int | None = None) -> DataFrame:
    """The files below ``roots``, ``(repo, address)`` pairs, that are ``wanted``, as a lazy frame.

    ``wanted`` is a condition on the source's columns; its comparisons reach the listing.  Later filters do not: Spark
    keeps the filters of a Python source with the frame that was loaded, and a second use of that frame with
    others would read by the first ones.  So every call loads a frame of its own and closes it to filters.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentTree)
    pairs = json.dumps([[repo, root.rstrip("/") or os.sep] for repo, root in roots])
    many = chunks or 4 * spark.sparkContext.defaultParallelism
    files = spark.read.format(NAME).option("roots", pairs).option("chunks", many).option("content", str(content).lower()).load()
    if wanted is not None:
        files = files.where(wanted)
    return files.withColumn("_part", F.spark_partition_id()).where("_part >= 0").drop("_part")
