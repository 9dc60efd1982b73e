"""Versions of a stored table: small files that name its parts, published one after the other.

``<path>/_versions/00000001.json`` holds what version 1 consists of.  Data is written below ``path`` under names of its own
first; a version is published by giving its file its number, which fails if another writer was faster.  So a
reader sees whole versions only, a killed job leaves the last one in place, and nobody's rows are lost.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.errors.exceptions.captured import convert_exception
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from docwarden.sources.files import split_address


class Conflict(RuntimeError):
    """Another writer has published the version that was to be published."""


def _system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    return hadoop, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    _, place, system = _system(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last published version; ``(0, {})`` if there is none."""
    _, place, system = _system(spark, f"{path}/_versions")
    if not system.exists(place):
        return 0, {}
    names = [s.getPath().getName() for s in system.listStatus(place)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(_read(spark, f"{path}/_versions/{max(numbers):08d}.json"))


def publish_file(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file whole, or raise :class:`Conflict` if it is already there."""
    hadoop, place, system = _system(spark, path)
    part = hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}.part")
    stream = system.create(part, False)
    try:
        stream.write(json.dumps(content).encode())
    finally:
        stream.close()
    try:
        target = system.makeQualified(place).toString()
        if target.startswith("file:"):
            # A rename replaces files on local disks; a link does not.
            os.link(split_address(system.makeQualified(part).toString())[1], split_address(target)[1])
        else:
            none = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
            none[0] = hadoop.fs.Options.Rename.NONE
            context = hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(part, place, none)
    except FileExistsError as taken:
        raise Conflict(path) from taken
    except Py4JJavaError as failed:
        if "FileAlreadyExistsException" in str(failed.java_exception.getClass().getName()):
            raise Conflict(path) from failed
        raise convert_exception(failed.java_exception) from failed
    finally:
        if system.exists(part):
            system.delete(part, False)


def publish(spark: SparkSession, path: str, after: int, content: dict) -> int:
    """Publish the version that follows ``after``; :class:`Conflict` if there is one already."""
    publish_file(spark, f"{path}/_versions/{after + 1:08d}.json", content)
    return after + 1


def change(spark: SparkSession, path: str, make: Callable[[int, dict], dict | None], tries: int = 20) -> int:
    """Publish what ``make(version, content)`` gives, anew from the last version whenever another writer was faster.

    ``None`` leaves the table as it is.
    """
    for _ in range(tries):
        version, content = latest(spark, path)
        new = make(version, content)
        if new is None:
            return version
        try:
            return publish(spark, path, version, new)
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} other versions were published meanwhile")
