"""Cutting lineage where iterations would repeat it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Rows and bytes (compressed) of a table that a join may broadcast by itself; a row takes some 160 bytes of the driver there.
SENT_ROWS, SENT_BYTES = 50_000, 1 << 20
#: Files of so few bytes hold few rows, which are not counted.
SMALL_BYTES = 16 << 10


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, which all executors share and which outlives them; where none
    is named (single-machine tests), an eager cache.

    Spark takes the compressed size for the size in memory, where whole lattices of a million places seem to be a few MB
    and would go through the driver; so joins shuffle tables of many rows (``apart``)."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        out = df.cache()
        return apart(out) if out.count() > SENT_ROWS else out
    path = f"{at.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    size = _bytes(spark, path)
    return apart(out) if size > SENT_BYTES or (size > SMALL_BYTES and out.count() > SENT_ROWS) else out


def apart(df: DataFrame) -> DataFrame:
    """df, not broadcast by any join but one that names it for that."""
    return df.hint("merge")


def _bytes(spark, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
