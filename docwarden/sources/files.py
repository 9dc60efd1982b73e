"""Files through Arrow's file systems.

A path is an address (``s3a://bucket/x``, ``hdfs://host/x``, ``file:/x``) or has no scheme; the latter are paths of Hadoop's
default file system (see :func:`docwarden.sources.corpus.addressed`).  Names are never parsed as addresses, so blanks
and signs in them do no harm.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

# Bytes of files that a task hands on at once.
READ_BYTES = 8 << 20
# Only these two mean that a single file or folder is out of reach; anything else fails the task, which is then repeated.
OUT_OF_REACH = (FileNotFoundError, PermissionError, NotADirectoryError)
_systems: dict[str, tuple] = {}


def split_address(path: str) -> tuple[str, str]:
    """``(scheme://host, path)``; the first part is empty for files of this machine."""
    scheme, found, rest = path.partition("://")
    if path.startswith("file:"):
        return "", "/" + path[len("file:") :].lstrip("/")
    if not found or "/" in scheme:
        return "", path
    host, _, inner = rest.partition("/")
    return f"{scheme}://{host}", "/" + inner


def file_system(path: str):
    """``(file system, path in it)``; one handle per host and worker."""
    from pyarrow import fs

    root, inner = split_address(path)
    if root not in _systems:
        if not root:
            _systems[root] = fs.LocalFileSystem(), ""
        else:
            scheme, _, host = root.partition("://")
            _systems[root] = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
    system, base = _systems[root]
    return system, base.rstrip("/") + inner if base.strip("/") or not root else inner


def entries(folder: str) -> Iterator[tuple[str, bool]]:
    """``(path, is_dir)`` of a folder; linked folders are not followed, those out of reach are empty."""
    from pyarrow import fs

    root, inner = split_address(folder)
    try:
        if not root:
            prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else "file:"
            with os.scandir(inner) as listing:
                for e in listing:
                    if not e.is_dir():
                        yield prefix + e.path, False
                    elif not e.is_symlink():
                        yield prefix + e.path, True
        else:
            system, place = file_system(folder)
            for info in system.get_file_info(fs.FileSelector(place)):
                yield folder.rstrip("/") + "/" + info.base_name, info.type == fs.FileType.Directory
    except OUT_OF_REACH:
        return


def read_bytes(path: str) -> bytes | None:
    """The content of a file; None if it is gone or may not be read."""
    try:
        system, inner = file_system(path)
        with system.open_input_stream(inner, compression=None) as f:
            return f.read()
    except OUT_OF_REACH:
        return None


def file_size(path: str) -> int | None:
    """Bytes of a file; None if it is gone or may not be looked at."""
    try:
        root, inner = split_address(path)
        if not root:
            return os.stat(inner).st_size
        system, place = file_system(path)
        return system.get_file_info(place).size
    except OUT_OF_REACH:
        return None


def _put(system, inner: str, part: str, data: bytes) -> None:
    """Write ``part`` and rename it to ``inner``; files of this machine without Arrow, at half the calls."""
    if system is None:
        with open(part, "wb", buffering=0) as f:
            rest = memoryview(data)
            while rest:
                rest = rest[f.write(rest) :]
        os.rename(part, inner)
    else:
        with system.open_output_stream(part, compression=None) as f:
            f.write(data)
        system.move(part, inner)


def write_bytes(path: str, data: bytes) -> None:
    """Write a file whole: under another name first, then renamed, so no reader sees a part of it."""
    root, inner = split_address(path)
    system = None
    if root:
        system, inner = file_system(path)
    folder, _, name = inner.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    try:
        if root:
            system.create_dir(folder or "/", recursive=True)
        try:
            _put(system, inner, part, data)
        except FileNotFoundError:
            if root:
                raise
            os.makedirs(folder or "/", exist_ok=True)  # only where it is missing
            _put(system, inner, part, data)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(part) if system is None else system.delete_file(part)
        raise


def delete_file(path: str) -> None:
    system, inner = file_system(path)
    system.delete_file(inner)
