"""Sources, sinks and streams' batch forms: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.operators.lifecycle import EXPORT_STEPS, FAILED
from voxelith.plans.queries import query


@query(" select x, y, z, cast(nx as double) as nx, red, green, blue, cast(okey as bigint) as source, confidence from points", "points")
def ply_round_trip(v):
    """Points as PLY files, a file a task, read in ranges of rows."""
    from voxelith.sources.files import new_folder
    from voxelith.sources.ply import PlySource

    v.spark.dataSource.register(PlySource)
    folder = new_folder(v.spark, "ply").removeprefix("file://")
    rows = v.points.select("x", "y", "z", "nx", *(F.col(c).cast("smallint").alias(c) for c in ("red", "green", "blue")), F.col("okey").cast("bigint").alias("source"), F.col("confidence").cast("double").alias("confidence"))
    rows.write.format("ply").mode("append").save(folder)
    return v.spark.read.format("ply").load(folder).withColumns({c: F.col(c).cast("int") for c in ("red", "green", "blue")})


@query(" select x, y, z, cast(1 + cast(substr(state, 12) as int) as bigint) as palette_id, state as block_state from blocks", "blocks")
def contract_round_trip(v):
    """Blocks as parts of a voxel world, range-partitioned in canonical order, each part decoded by itself."""
    from voxelith.sources import voxels
    from voxelith.sources.files import new_folder

    folder = new_folder(v.spark, "voxels")
    palette = v.spark.createDataFrame([(1 + i, f"minecraft:s{i}") for i in range(7)], "palette_id int, block_state string")
    voxels.write(v.blocks.select("x", "y", "z", (F.substring("state", 12, 9).cast("int") + 1).alias("palette_id")), palette, folder, part_rows=10_000)
    return voxels.read_parts(v.spark, folder)


@query(" select stage, status, count(*) as n, cast(sum(ms) as bigint) as ms from metrics group by 1, 2", "metrics")
def appended_metrics(v):
    """Stage metrics appended in four batches, two of which come again."""
    from voxelith.sources.files import new_folder
    from voxelith.streaming.sink import AppendLog

    log = AppendLog(v.spark, new_folder(v.spark, "metrics"))
    for batch in (0, 1, 1, 2, 3, 0):
        log.append(v.metrics.where(F.col("event_id") % 4 == batch), batch)
    return log.read().groupBy("stage", "status").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))


_STATES = [*EXPORT_STEPS, FAILED]
_STATE_SQL = "case event_id * 7 % 11 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STATES)) + f" else '{_STATES[1]}' end"


@query(f""", e as (select event_id, job, started_at as "at", {_STATE_SQL} as target from metrics),
 s as (select *, lag(target) over w as source, first_value("at") over w as started_at, coalesce(max(case when target in ('READY', 'FAILED') then 1 else 0 end) over (partition by job order by "at", event_id rows between unbounded preceding and 1 preceding), 0) as done from e window w as (partition by job order by "at", event_id)),
 t(source, target) as (values ('QUEUED', 'VOXELIZING'), ('VOXELIZING', 'GENERATING_WORLD'), ('GENERATING_WORLD', 'READY'), ('QUEUED', 'FAILED'), ('VOXELIZING', 'FAILED'), ('GENERATING_WORLD', 'FAILED'))
 select job, 'ILLEGAL' as kind, source, target, "at", cast(null as timestamp) as started_at from s where done = 0 and source is not null and source <> target and not exists (select 1 from t where t.source = s.source and t.target = s.target)
 union all select job, 'END_TO_END', source, target, "at", started_at from s where done = 0 and target in ('READY', 'FAILED')""", "metrics")
def judged_jobs(v):
    """Illegal steps and ends of every job, as the stream of job events gives them."""
    from voxelith.streaming.jobs import judged

    state = F.lit(_STATES[1])
    for i, s in enumerate(_STATES):
        state = F.when(F.col("event_id") * 7 % 11 == i, s).otherwise(state)
    return judged(v.metrics.select("event_id", "job", state.alias("state"), F.col("started_at").alias("at")), EXPORT_STEPS)


@query(None)
def trajectory_outliers(v):
    """Poses that leave their rig's path; tests hold it against the step-by-step definition."""
    from voxelith.operators.trajectory import trajectory_outliers as found

    return found(v.cameras.withColumn("cam", F.col("cam").cast("int")), ["rig"], "cam")


@query(" select event_id, cast(greatest(0, round_even((event_id % 4001 - 1000) * 500 / 1e3, 0)) as bigint) as ms from metrics", "metrics")
def bounded_durations(v):
    """Durations in whole milliseconds, none below 0."""
    from voxelith.operators.lifecycle import elapsed_ms

    ended = F.timestamp_micros(F.unix_micros(F.col("started_at").cast("timestamp")) + (F.col("event_id") % 4001 - 1000) * 500)
    return v.metrics.select("event_id", elapsed_ms(F.col("started_at").cast("timestamp"), ended).alias("ms"))
