"""A table that grows by batches, each of which counts once: Parquet files, and a manifest for every batch.

A batch's files are written first and are not part of the table; its manifest, created under the batch's number or not at
all, makes them so.  A batch that comes again, after a failure or from a second writer, finds its manifest and adds nothing.
Manifests hold each file's size and SHA-256, worked out by the executors.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.sources.objects import Exists, NotFound, Store, checksums


class AppendLog:
    """A folder with ``data`` and ``log``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def append(self, batch: DataFrame, batch_id: int) -> bool:
        """Add a batch's rows, unless its number has been added; whether it was.  Use as ``foreachBatch(log.append)``."""
        key = f"log/{batch_id:020d}.json"
        if self.store.exists(key):
            return False
        part = f"data/{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(self.store.path(part))
        files = [r.asDict() for r in checksums(self.spark, self.store.path(part), "*.parquet").orderBy("path").collect()]  # a row a file
        entry = {"batch": batch_id, "schema": batch.schema.jsonValue(), "files": [{"path": f"{part}/{f['path'].rsplit('/', 1)[1]}", "size": f["size"], "sha256": f["sha256"]} for f in files]}
        try:
            self.store.create(key, json.dumps(entry).encode(), checksum=False)
        except Exists:  # another writer was first
            self.store.delete(part)
            return False
        return True

    def batches(self) -> list[dict]:
        return [json.loads(self.store.read(k)) for k in self.store.keys("log")]

    def read(self) -> DataFrame:
        """The rows of all batches that have a manifest; columns that later batches added are null before."""
        entries = self.batches()
        if not entries:
            raise NotFound("the table has no batch")
        paths = [self.store.path(f["path"]) for e in entries for f in e["files"]]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def faults(self) -> DataFrame:
        """(path, fault) of files that are missing or changed since their manifest."""
        said = [(self.store.path(f["path"]).split(":", 1)[-1].replace("///", "/"), f["size"], f["sha256"]) for e in self.batches() for f in e["files"]]
        want = self.spark.createDataFrame(said, "path string, size bigint, sha256 string")
        have = checksums(self.spark, self.store.path("data"), "*.parquet").select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
        fault = F.when(F.col("_sha").isNull(), "missing").when((F.col("_size") != F.col("size")) | (F.col("_sha") != F.col("sha256")), "changed")
        return want.join(have, "path", "left").select("path", fault.alias("fault")).where("fault is not null")
