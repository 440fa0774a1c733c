"""Folders that drivers and executors share, by path or URI, for the sources and sinks that read and write files themselves."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

_made: list[str] = []


def resolve(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs), and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def names(path: str, suffix: str) -> list[str]:
    """Paths of a folder's files with a suffix, or the path itself, in order; as `resolve` gives them."""
    fs, at = resolve(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        return [at]
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=False, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(suffix))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the one that spark.checkpoint.dir names, removed when the driver ends.  Only where the
    session runs in one process may the setting be absent: executors elsewhere would not see the driver's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="voxelith-")
        _made.append(at)
    path = f"{at.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    fs, inner = resolve(path)
    fs.create_dir(inner, recursive=True)
    _made.append(path)
    return path


@atexit.register
def _sweep() -> None:
    for path in reversed(_made):
        try:
            fs, inner = resolve(path)
            fs.delete_dir(inner)
        except OSError:  # gone already
            pass
