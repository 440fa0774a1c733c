"""States, failures and stage metrics of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The life of a scan and of an export, in order, with what each step adds to progress.
SCAN_STEPS = ["CREATED", "UPLOADING", "UPLOADED", "QUEUED", "PREPROCESSING", "RECONSTRUCTING", "FILTERING", "PREVIEW_READY", "READY"]
EXPORT_STEPS = ["QUEUED", "VOXELIZING", "GENERATING_WORLD", "READY"]
FAILED = "FAILED"


def transitions(steps: list[str]) -> list[tuple[str, str]]:
    """Each step leads to the next; all but the last may fail."""
    return [*zip(steps, steps[1:], strict=False), *((s, FAILED) for s in steps[:-1])]


def transition_table(spark, steps: list[str]) -> DataFrame:
    return spark.createDataFrame(transitions(steps), "source string, target string")


def violations(history: DataFrame, allowed: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Steps of a history that the table does not allow."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = history.withColumns({"source": F.lag(state).over(w), "target": F.col(state)}).where("source is not null and source <> target")
    return steps.join(F.broadcast(allowed), ["source", "target"], "left_anti")  # the table is a constant


def progress(state: Column, steps: list[str]) -> Column:
    """Share of the steps that are done, in per cent."""
    return F.round(100 * (F.array_position(F.array(*map(F.lit, steps)), state) - 1) / (len(steps) - 1), 0).cast("int")


def classify(message: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Code of the first rule whose text is in the message, ignoring case."""
    out = None
    for text, code in rules:
        hit = F.lower(message).contains(text)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(otherwise)


def durations(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and stage: attempts, failures, total and greatest duration."""
    return metrics.groupBy(*keys, "stage").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == FAILED).alias("failures"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))


def end_to_end(metrics: DataFrame, job: str) -> DataFrame:
    """One terminal row a job: first start to last end, failed if any stage failed."""
    return metrics.groupBy(job).agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.when(F.count_if(F.col("status") == FAILED) > 0, FAILED).otherwise("COMPLETED").alias("status"))


def new_work(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose result does not exist yet; equal requests count once."""
    return requests.dropDuplicates(keys).join(done.select(*keys).distinct(), keys, "left_anti")


def overlapping(metrics: DataFrame, job: str) -> DataFrame:
    """Stages that began before an earlier stage of their job had ended."""
    w = Window.partitionBy(job).orderBy("started_at", "stage").rowsBetween(Window.unboundedPreceding, -1)
    return metrics.withColumn("_end", F.max("ended_at").over(w)).where(F.col("started_at") < F.col("_end")).drop("_end")


def wall_clock(start_us: Column, start_ns: Column, ns: Column) -> Column:
    """Microseconds of wall clock of a monotonic reading, halves up; null before the start."""
    d = ns - start_ns
    return F.when(d >= 0, start_us + F.floor((d + 500) / 1000))


def elapsed_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds between two instants, halves to even; clocks that ran backwards count as 0."""
    return F.greatest(F.lit(0), F.rint((F.unix_micros(ended) - F.unix_micros(started)) / 1000)).cast("bigint")


def with_added_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)
