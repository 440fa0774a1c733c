"""Objects in any store that Spark reaches: bytes with a checksum, and files that may be created once only.

Everything goes through Hadoop's file systems, so a local folder, HDFS and object stores are alike.  An object's SHA-256 is
kept beside it, in a file of the same name with ``.sha256`` after it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotFound(KeyError):
    """No such object."""


class Exists(ValueError):
    """The object is there already."""


@dataclass(frozen=True)
class Head:
    size: int
    sha256: str | None


class Store:
    """Objects below a root, by key."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, key: str) -> str:
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"key {key!r}")
        return f"{self.root}/{key}"

    def _at(self, key: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.path(key))
        return p.getFileSystem(self._conf), p

    def exists(self, key: str) -> bool:
        fs, p = self._at(key)
        return fs.exists(p)

    def head(self, key: str) -> Head:
        fs, p = self._at(key)
        if not fs.exists(p):
            raise NotFound(key)
        return Head(fs.getFileStatus(p).getLen(), self.read(f"{key}.sha256", check=False).decode() if self.exists(f"{key}.sha256") else None)

    def read(self, key: str, check: bool = True) -> bytes:
        """An object's bytes (through the driver: for small ones); check: against its checksum, if it has one."""
        fs, p = self._at(key)
        if not fs.exists(p):
            raise NotFound(key)
        stream = fs.open(p)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        if check and self.exists(f"{key}.sha256") and self.read(f"{key}.sha256", check=False).decode() != hashlib.sha256(raw).hexdigest():
            raise ValueError(f"{key}: checksum differs")
        return raw

    def create(self, key: str, raw: bytes, sha256: str | None = None, checksum: bool = True) -> None:
        """A new object; raises Exists if there is one, and ValueError if the bytes are not those of the checksum."""
        own = hashlib.sha256(raw).hexdigest()
        if sha256 not in (None, own):
            raise ValueError(f"{key}: the bytes have another checksum")
        fs, p = self._at(key)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception.getMessage()).lower() or fs.exists(p):
                raise Exists(key) from e
            raise
        try:
            stream.write(raw)
        finally:
            stream.close()
        if checksum:
            self.create(f"{key}.sha256", own.encode(), checksum=False)

    def keys(self, prefix: str) -> list[str]:
        """Keys directly below a prefix, in order, without checksums."""
        fs, p = self._at(prefix)
        if not fs.exists(p):
            return []
        return sorted(f"{prefix}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().endswith((".sha256", ".crc")))

    def delete(self, key: str) -> None:
        fs, p = self._at(key)
        fs.delete(p, True)


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of every file under a path, worked out where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
