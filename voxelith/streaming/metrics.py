"""Stage metrics as a stream: windowed counts and durations, each attempt counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window and stage: attempts, failures, total duration.  Rows later than ``late`` are dropped, as are attempts
    (event_id) that come again within that time, so state stays bounded.  Works on a batch as well."""
    df = stream.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["event_id"]) if stream.isStreaming else stream.dropDuplicates(["event_id"])
    return df.groupBy(F.window("started_at", window).alias("w"), "stage").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "FAILED").alias("failures"), F.sum("ms").alias("total_ms")
    ).select(F.col("w.start").alias("start"), "stage", "attempts", "failures", "total_ms")
