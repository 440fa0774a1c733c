"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (single-machine tests), a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.voxelith.checkpoint", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="voxelith-")
        spark.conf.set("spark.voxelith.checkpoint", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: later reads survive lost executors and do not recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Size of a stored table's files; more than any limit for another."""
    path = getattr(df, "_stored_at", None)
    if not path:
        return 1 << 62
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


#: Bytes and rows of a batch that Python workers get; batches of texts are copied a few times there.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with batches small enough for several workers in one executor."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def drop(df: DataFrame | None) -> None:
    """Delete a stored table that no later plan reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to any more, so that executors delete their files now and not
    when the driver happens to collect its garbage; for operators of many large steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return
