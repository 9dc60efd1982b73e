"""Where documents come from: tables, file lists, directory trees and binary-file scans.

All sources give the same frame: ``doc_key, repo, path, abs_path, content, size_bytes,
content_hash``.  ``(repo, path, abs_path)`` is the order of documents wherever an order is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import text as tx
from docwarden.operators.candidates import EXTENSIONS, IGNORED_DIRS, TEXT_GLOB, has_text_extension, in_ignored_dir
from docwarden.sources.files import READ_BYTES, delete_file, file_system, read_bytes, split_address, write_bytes  # noqa: F401
from docwarden.sources.tree import read_tree

DOC_COLUMNS = ("doc_key", "repo", "path", "abs_path", "content", "size_bytes", "content_hash")


def doc_key() -> Column:
    return F.sha2(F.concat_ws("\0", "repo", "path", "abs_path"), 256)


def as_docs(raw: DataFrame, size_bytes: Column | None = None) -> DataFrame:
    """A frame with ``repo, path, abs_path, content`` (text or bytes) as documents."""
    size = F.octet_length("content") if size_bytes is None else size_bytes
    return (
        raw.select("repo", "path", "abs_path", size.cast("long").alias("size_bytes"), tx.normalise_text(F.col("content")).alias("content"))
        .withColumn("doc_key", doc_key())
        .withColumn("content_hash", tx.content_hash(F.col("content")))
        .select(*DOC_COLUMNS)
    )


def corpus_from_table(table: DataFrame, repo: Column, path: Column, content: Column, abs_path: Column | None = None) -> DataFrame:
    """Documents from any table; without ``abs_path`` one is made from repository and path."""
    where = F.concat(F.lit("/corpus/"), repo, F.lit("/"), path) if abs_path is None else abs_path
    return as_docs(
        table.select(repo.alias("repo"), path.alias("path"), where.alias("abs_path"), content.alias("content"))
    )


# ---------------------------------------------------------------------------------------------
# Files


def addressed(spark: SparkSession, path: Column) -> Column:
    """Paths without a scheme as addresses of the default file system; local ones stay plain paths."""
    default = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "").rstrip("/")
    if not default or default.startswith("file:"):
        return path
    return F.when(path.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit(default), path))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["repo", "path", "abs_path"]
    for batch in batches:
        start, held, size = 0, [], 0
        for at, address in enumerate(batch.column("address").to_pylist()):
            content = read_bytes(address)
            held.append(content)
            size += len(content or b"")
            if size >= READ_BYTES or at == batch.num_rows - 1:
                content, held, size = pa.array(held, pa.binary()), [], 0
                yield pa.RecordBatch.from_arrays([*batch.select(names).slice(start, len(content)).columns, content], names=[*names, "content"])
                start = at + 1


def read_contents(files: DataFrame) -> DataFrame:
    """``files(repo, path, abs_path)`` with ``content``; NULL where a file is gone or may not be read."""
    spark = files.sparkSession
    named = files.select("repo", "path", "abs_path", addressed(spark, F.col("abs_path")).alias("address"))
    spread = named.repartition(spark.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(_read_files, "repo string, path string, abs_path string, content binary")


def read_files(files: DataFrame) -> DataFrame:
    """Documents of ``files(repo, path, abs_path)`` that can be read."""
    return as_docs(read_contents(files).where(F.col("content").isNotNull()))


def tree_roots(spark: SparkSession, roots: DataFrame) -> list[tuple[str, str]]:
    """``roots(repo, root)`` with addresses; a list that somebody wrote, so it is small."""
    rows = roots.select("repo", addressed(spark, F.col("root")).alias("root")).collect()
    return [(r["repo"], r["root"]) for r in rows]


def scan_tree(roots: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Text documents below ``roots(repo, root)``, read lazily by the data source :mod:`docwarden.sources.tree`.

    The suffix test and the comparisons of ``wanted``, a condition on ``repo``, ``path`` (below its root), ``suffix`` and
    ``size_bytes``, reach the listing: folders and files that cannot match are neither entered nor opened.
    """
    spark = roots.sparkSession
    text = F.col("suffix").isin(*EXTENSIONS)
    files = read_tree(spark, tree_roots(spark, roots), text if wanted is None else text & wanted)
    return as_docs(files.select("repo", "path", "abs_path", "content"))


def scan_files(paths: DataFrame) -> DataFrame:
    """Documents of an explicit list ``paths(path)``; the repository is the parent folder."""
    p = F.col("path")
    name = F.substring_index(p, "/", -1)
    parent = F.when(F.contains(p, F.lit("/")), F.substr(p, F.lit(1), F.char_length(p) - F.char_length(name) - 1)).otherwise(".")
    return read_files(paths.select(F.when(parent == "", "/").otherwise(parent).alias("repo"), name.alias("path"), p.alias("abs_path")))


def _listed_by_spark(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Folders and files below ``root`` that Spark's listing leaves out, for stores that only Hadoop knows.

    Folders are listed on the driver; skipped ones are not entered.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: tuple[list[str], list[str]] = [], []
    folders = [path]
    while folders:
        for status in system.listStatus(folders.pop()):
            name = status.getPath().getName()
            if status.isDirectory() and name in IGNORED_DIRS:
                continue
            if name[:1] in "._":
                found[status.isFile()].append(status.getPath().toString())
            if status.isDirectory():
                folders.append(status.getPath())
    return found


def _known_to_arrow(address: str) -> bool:
    try:
        file_system(address)
    except (ValueError, ImportError, OSError):  # no such scheme, no library for it, or no host
        return False
    return True


def scan_object_store(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """Documents below ``root`` through Spark's own file reading.

    ``abs_path`` keeps the address.  Spark's listing skips names with a leading dot or underscore; files with such a part
    in their path are listed and read by the tasks of the data source :mod:`docwarden.sources.tree`.  Only for
    addresses of a kind that Arrow does not know the driver looks hidden names up.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = system.makeQualified(path).toString().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", TEXT_GLOB)
    folders, files = ([], None) if _known_to_arrow(base) else _listed_by_spark(spark, base)
    # Names are taken literally, not as patterns.
    raw = reader.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in (base, *folders)]).select("path", "content", "length")
    if files is None:
        names = read_tree(spark, [(repo, base)], F.col("suffix").isin(*EXTENSIONS) & F.col("path").rlike(r"(?s)(?:\A|/)[._]"), content=False)
        single = names.select("repo", F.col("abs_path").alias("path"), "abs_path")
    else:  # Spark reads no hidden file, even by its name
        single = spark.createDataFrame([(repo, f, f) for f in files], "repo string, path string, abs_path string").where(has_text_extension(F.col("path")))
    single = read_contents(single).where(F.col("content").isNotNull())
    raw = raw.unionByName(single.select("path", "content", F.octet_length("content").cast("long").alias("length")))
    return as_docs(named_below(raw.dropDuplicates(["path"]), repo, base), F.col("size"))


def named_below(raw: DataFrame, repo: str, base: str) -> DataFrame:
    """Files ``raw(path, content, length)`` by their place below the address ``base``."""
    place = F.substr("path", F.lit(len(base) + 2))
    local = F.regexp_replace("path", r"\Afile:/+", "/")
    named = raw.select(F.lit(repo).alias("repo"), place.alias("path"), local.alias("abs_path"), "content", F.col("length").alias("size"))
    return named.where(has_text_extension(F.col("path")) & ~in_ignored_dir(F.col("path")))


def sources_table(roots: DataFrame, found: DataFrame, key: str = "label", found_key: str = "repo") -> DataFrame:
    """Per source its record and how many candidates it gave; sources without any stay listed.

    Sources may share a label; with a ``key`` column that tells them apart (and candidates that carry it
    as ``found_key``) each gets its own count.
    """
    counts = found.groupBy(F.col(found_key).alias("_found")).agg(F.count("*").alias("n_candidates"))
    return roots.join(counts, roots[key] == counts["_found"], "left").select(
        *roots.columns, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")
    )
