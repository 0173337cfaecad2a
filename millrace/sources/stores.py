"""Files that tasks open themselves, wherever they lie: local folders, and the stores that pyarrow knows (S3, GCS, HDFS)."""

from __future__ import annotations

import os
from contextlib import suppress

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Raises ValueError for stores that only Spark reads."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    try:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    except (ValueError, OSError) as e:
        raise ValueError(f"no file system for {path}") from e


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files under a folder but hidden ones, in order. Paths are those of the store."""
    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = where.get_file_info(fs.FileSelector(at, recursive=True))
    plain = lambda p: not any(x[:1] in "_." for x in p[len(at) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and plain(f.path))


class Commit:
    """A folder that is written in two steps: tasks write files under a hidden folder, and when all are done those move in.
    What a failed or repeated task leaves behind never shows."""

    def __init__(self, path: str, job: str):
        self.path, self.hidden = path, f"_temporary-{job}"

    def open(self, name: str):
        """A new hidden file, for writing."""
        where, at = store(self.path)
        where.create_dir(f"{at}/{self.hidden}", recursive=True)
        return where.open_output_stream(f"{at}/{self.hidden}/{name}", compression=None)

    def finish(self, names: list[str], overwrite: bool) -> None:
        """Let these files show; with overwrite, delete what was there before."""
        where, at = store(self.path)
        where.create_dir(at, recursive=True)
        before = [f for f, _ in files_of(self.path)] if overwrite else []
        for name in names:
            where.move(f"{at}/{self.hidden}/{name}", f"{at}/{name}")
        for f in before:
            where.delete_file(f)
        self.drop()

    def drop(self) -> None:
        where, at = store(self.path)
        with suppress(OSError):
            where.delete_dir(f"{at}/{self.hidden}")
