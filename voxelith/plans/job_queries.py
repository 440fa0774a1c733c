"""Keyframes, trajectories, pixels, states and stage metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelith.operators import lifecycle as L
from voxelith.operators.frames import changes, edge_filter, keyframes, match_pairs, quality_gate, step_ratios, usable, z_buffer
from voxelith.plans.queries import query

USABLE = ", good as (select * from frames where brightness between 18 and 238 and clipped <= 0.35 and sharpness >= 0.08)"


@query(USABLE + " select event_id from good", "frames")
def usable_frames(v):
    return usable(v.frames).select("event_id")


@query(USABLE + ", d as (select *, coalesce(abs(value - lag(value) over (partition by user_id order by ts, event_id)), 1.0) as difference from good) select event_id, round(difference, 6) as difference from d where difference >= 0.6", "frames")
def changed_frames(v):
    return changes(usable(v.frames), "value", ["ts", "event_id"], ["user_id"]).where("difference >= 0.6").select("event_id", F.round("difference", 6).alias("difference"))


@query(USABLE + """, n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from good),
 b as (select n.*, k as bin from n, unnest(range(0, 12)) as u(k) where k < least(12, n) and i >= k * n // least(12, n) and i < (k + 1) * n // least(12, n))
 select user_id, cast(bin as int) as bin, arg_max(event_id, {'s': sharpness, 'i': -i}) as event_id, count(*) as candidates from b group by 1, 2""", "frames")
def select_keyframes(v):
    return keyframes(usable(v.frames), ["user_id"], ["ts", "event_id"], "event_id", "sharpness", 12)


@query(", s as (select rig, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2) / (cam - lag(cam) over w) as step from cameras window w as (partition by rig order by cam)), m as (select rig, max(step) as g, median(step) filter (step > 0) as t from s where step is not null group by 1) select rig, round(g, 6) as greatest, round(t, 6) as typical, round(g / t, 6) as ratio from m where t > 0", "cameras")
def trajectory_steps(v):
    return step_ratios(v.cameras, ["rig"], "cam", ("x", "y", "z")).select("rig", *(F.round(c, 6).alias(c) for c in ("greatest", "typical", "ratio")))


@query(", n as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from frames) select a.user_id, cast(a.i as int) as i, cast(b.i as int) as j from n a join n b on a.user_id = b.user_id and b.i > a.i where a.n <= 60 or b.i - a.i <= 5 or b.i - a.i in (8, 16, 32, 64, 128, 256, 512, 1024)", "frames")
def match_candidates(v):
    return match_pairs(v.frames.select("user_id", F.struct("ts", "event_id").alias("at")), ["user_id"], "at", exhaustive=60, near=5).select("user_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))


@query(" select frame, round(avg(grey), 6) as mean, round(avg(case when grey <= 5 or grey >= 250 then 1e0 else 0e0 end), 6) as clipped, round(var_pop(grey) / greatest(avg(grey), 16), 6) as contrast from pixels group by 1", "pixels")
def image_moments(v):
    return v.pixels.groupBy("frame").agg(
        F.round(F.avg("grey"), 6).alias("mean"), F.round(F.avg(F.when((F.col("grey") <= 5) | (F.col("grey") >= 250), 1.0).otherwise(0.0)), 6).alias("clipped"),
        F.round(F.var_pop("grey") / F.greatest(F.avg("grey"), F.lit(16)), 6).alias("contrast"),
    )


@query(", l as (select a.frame, 4 * a.grey - b.grey - c.grey - d.grey - e.grey as k, a.grey from pixels a join pixels b on b.frame = a.frame and b.v = a.v - 1 and b.u = a.u join pixels c on c.frame = a.frame and c.v = a.v + 1 and c.u = a.u join pixels d on d.frame = a.frame and d.v = a.v and d.u = a.u - 1 join pixels e on e.frame = a.frame and e.v = a.v and e.u = a.u + 1) select frame, round(var_pop(k), 6) as sharpness, count(*) as n from l group by 1", "pixels")
def laplacian_variance(v):
    p = v.pixels
    taps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for a, b, k in ((0, 0, 4), (1, 0, -1), (-1, 0, -1), (0, 1, -1), (0, -1, -1)))))
    lap = p.withColumn("t", taps).groupBy("frame", (F.col("v") + F.col("t.a")).alias("v"), (F.col("u") + F.col("t.b")).alias("u")).agg(F.sum(F.col("grey") * F.col("t.k")).alias("k"), F.count("*").alias("c"))
    return lap.where("c = 5").groupBy("frame").agg(F.round(F.var_pop("k"), 6).alias("sharpness"), F.count("*").alias("n"))


@query(" select b.frame, round(sum(abs(a.grey - b.grey)) / (255e0 * count(*)), 9) as difference, count(*) as n from pixels a join pixels b on b.frame = a.frame + 4 and a.v = b.v and a.u = b.u group by 1", "pixels")
def frame_difference(v):
    a = v.pixels.select((F.col("frame") + 4).alias("frame"), "v", "u", F.col("grey").alias("o"))
    return v.pixels.join(a, ["frame", "v", "u"]).groupBy("frame").agg(F.round(F.sum(F.abs(F.col("grey") - F.col("o"))) / (255.0 * F.count("*")), 9).alias("difference"), F.count("*").alias("n"))


@query(" select a.frame, a.v, a.u, a.grey as depth from pixels a join pixels b on b.frame = a.frame and abs(a.v - b.v) <= 1 and abs(a.u - b.u) <= 1 and b.grey > 0 where a.grey > 0 group by 1, 2, 3, 4 having max(b.grey) - min(b.grey) <= 0.5 * a.grey", "pixels")
def occlusion_edges(v):
    return edge_filter(v.pixels.withColumnRenamed("grey", "depth"), 0.5).select("frame", "v", "u", "depth")


@query(" select frame, v // 4 as v, u // 4 as u, min(grey) as depth from pixels group by 1, 2, 3", "pixels")
def depth_buffer(v):
    return z_buffer(v.pixels.withColumnRenamed("grey", "depth"))


@query(" select frame, v, u from pixels where v % 8 = 4 and u % 8 = 4 and v between 1 and 22 and u between 1 and 30", "pixels")
def strided_pixels(v):
    return v.pixels.where("v % 8 = 4 and u % 8 = 4 and v between 1 and 22 and u between 1 and 30").select("frame", "v", "u")


@query(" select frame, count(*) as anchors, count(*) filter (grey > 0) as valid from pixels group by 1 having count(*) >= 20 and count(*) filter (grey > 0) >= 0.05 * 768", "pixels")
def anchor_sufficiency(v):
    return v.pixels.groupBy("frame").agg(F.count("*").alias("anchors"), F.count_if(F.col("grey") > 0).alias("valid")).where("anchors >= 20 and valid >= 0.05 * 768")


@query(" select frame, v, u, dense as rank, donor from (select a.frame, a.v, a.u, b.frame as donor, row_number() over (partition by a.frame, a.v, a.u order by b.grey desc, b.frame) as dense from pixels a join pixels b on a.v = b.v and a.u = b.u and a.frame <> b.frame) where dense <= 10", "pixels")
def top_source_views(v):
    a = v.pixels.select("frame", "v", "u")
    b = v.pixels.select(F.col("frame").alias("donor"), "v", "u", "grey")
    w = Window.partitionBy("frame", "v", "u").orderBy(F.desc("grey"), "donor")
    return a.join(b, ["v", "u"]).where("frame <> donor").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("frame", "v", "u", "rank", "donor")


@query(", g as (select user_id, count(*) as n, avg(brightness) as b, median(clipped) as c, max(sharpness) as s from frames group by 1) select user_id, concat_ws(',', case when n < 95 then 'FEW_FRAMES' end, case when b < 200 then 'DARK' end, case when c > 0.24 then 'CLIPPED' end, case when s < 0.95 then 'BLURRED' end) as failures from g", "frames")
def gate(v):
    g = v.frames.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("brightness").alias("b"), F.median("clipped").alias("c"), F.max("sharpness").alias("s"))
    return quality_gate(g, [("FEW_FRAMES", "n < 95"), ("DARK", "b < 200"), ("CLIPPED", "c > 0.24"), ("BLURRED", "s < 0.95")]).select("user_id", F.array_join("failures", ",").alias("failures"))


@query(" select o_orderkey as job, cast(least(240, greatest(30, round_even((o_orderkey % 90) * 2.5e0, 0))) as int) as frames from orders")
def frame_targets(v):
    return v.table("orders").select(F.col("o_orderkey").alias("job"), F.least(F.lit(240), F.greatest(F.lit(30), F.bround(F.col("o_orderkey") % 90 * 2.5))).cast("int").alias("frames"))


@query(" select stage, count(*) as attempts, count(*) filter (status = 'FAILED') as failures, cast(sum(ms) as bigint) as total_ms, max(ms) as max_ms from metrics group by 1", "metrics")
def stage_durations(v):
    return L.durations(v.metrics.withColumn("all", F.lit(1)), ["all"]).drop("all")


@query(" select job, epoch_us(min(started_at)) as started, max(epoch_us(started_at) + ms * 1000) as ended_us, case when count(*) filter (status = 'FAILED') > 0 then 'FAILED' else 'COMPLETED' end as status from metrics group by 1", "metrics")
def end_to_end_rows(v):
    m = v.metrics.withColumn("ended_at", F.unix_micros(F.col("started_at").cast("timestamp")) + F.col("ms") * 1000)
    return L.end_to_end(m, "job").select("job", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started"), F.col("ended_at").alias("ended_us"), "status")


@query(", t as (select *, epoch_us(started_at) as a, epoch_us(started_at) + ms * 1000 as b from metrics), o as (select *, max(b) over (partition by job order by a, stage, event_id rows between unbounded preceding and 1 preceding) as e from t) select event_id from o where a < e", "metrics")
def overlapping_stages(v):
    a = F.unix_micros(F.col("started_at").cast("timestamp"))
    w = Window.partitionBy("job").orderBy("a", "stage", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return v.metrics.withColumn("a", a).withColumn("e", F.max(F.col("a") + F.col("ms") * 1000).over(w)).where("a < e").select("event_id")


_STEPS = {"view": "QUEUED", "click": "VOXELIZING", "purchase": "GENERATING_WORLD"}
_CASE = "case stage when 'view' then 'QUEUED' when 'click' then 'VOXELIZING' when 'purchase' then 'GENERATING_WORLD' when 'error' then 'FAILED' else 'READY' end"


@query(f", h as (select job, event_id, started_at, {_CASE} as state from metrics), s as (select job, event_id, lag(state) over (partition by job order by started_at, event_id) as source, state as target from h) select job, event_id, source, target from s where source is not null and source <> target and (source, target) not in (('QUEUED', 'VOXELIZING'), ('VOXELIZING', 'GENERATING_WORLD'), ('GENERATING_WORLD', 'READY'), ('QUEUED', 'FAILED'), ('VOXELIZING', 'FAILED'), ('GENERATING_WORLD', 'FAILED'))", "metrics")
def illegal_transitions(v):
    s = F.lit("READY")
    for k, t in {**_STEPS, "error": "FAILED"}.items():
        s = F.when(F.col("stage") == k, t).otherwise(s)
    h = v.metrics.select("job", "event_id", "started_at", s.alias("state"))
    return L.violations(h, L.transition_table(v.spark, L.EXPORT_STEPS), ["job"], ["started_at", "event_id"], "state").select("job", "event_id", "source", "target")


@query(" select p_partkey as job, case when contains(lower(p_name), 'ring') then 'RING' when contains(lower(p_name), 'red') then 'RED' when contains(lower(p_type), 'eco') then 'ECO' else 'OTHER' end as code from part")
def failure_codes(v):
    p = v.table("part")
    name = L.classify(F.col("p_name"), [("ring", "RING"), ("red", "RED")], "")
    return p.select(F.col("p_partkey").alias("job"), F.when(name != "", name).otherwise(L.classify(F.col("p_type"), [("eco", "ECO")], "OTHER")).alias("code"))


@query(" select c_custkey as scan, count(o_orderkey) as exports, count(*) filter (o_orderstatus = 'F') as failed, max(o_totalprice) as dearest from customer left join orders on o_custkey = c_custkey group by 1")
def scan_exports(v):
    o = v.table("orders")
    return v.table("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("scan")).agg(
        F.count("o_orderkey").alias("exports"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.max("o_totalprice").alias("dearest")
    )


@query(" select distinct o_custkey % 50 as k, o_orderpriority as mode from orders where not exists (select 1 from customer where c_custkey % 50 = o_custkey % 50 and c_acctbal < 0 and c_nationkey % 5 = length(o_orderpriority) % 5)")
def new_requests(v):
    r = v.table("orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("mode"), (F.length("o_orderpriority") % 5).alias("m"))
    done = v.table("customer").where("c_acctbal < 0").select((F.col("c_custkey") % 50).alias("k"), (F.col("c_nationkey") % 5).alias("m"))
    return r.dropDuplicates(["k", "mode"]).join(done.distinct(), ["k", "m"], "left_anti").select("k", "mode")


@query(" select o_orderkey as scan, epoch_ms(o_orderdate + interval 30 day) as deadline, o_orderdate + interval 30 day < timestamp '1999-01-01' as expired from orders")
def retention(v):
    d = F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")
    return v.table("orders").select(F.col("o_orderkey").alias("scan"), F.unix_millis(d).alias("deadline"), (d < F.lit("1999-01-01").cast("timestamp")).alias("expired"))


@query(" select event_id, case when event_id % 7 = 0 then null else 1700000000000000 + (event_id * 977 + 500) // 1000 end as us from metrics", "metrics")
def wall_clock_readings(v):
    start, ns = F.lit(10**9), F.when(F.col("event_id") % 7 == 0, F.lit(5)).otherwise(F.lit(10**9) + F.col("event_id") * 977)
    return v.metrics.select("event_id", L.wall_clock(F.lit(1_700_000_000_000_000), start, ns).alias("us"))


@query(" select event_id, cast(json_extract(props, '$.k') as int) as k, case when json_extract(props, '$.missing') is null then 'unknown' else 'set' end as extra from events")
def manifest_values(v):
    p = F.from_json("props", "k int, missing string")
    return v.table("events").select("event_id", p["k"].alias("k"), F.coalesce(F.when(p["missing"].isNotNull(), "set"), F.lit("unknown")).alias("extra"))


@query(", l as (select event_id, 'I0101 ] ' || 'Registered images = ' || cast(event_id * 1234567 % 10000000 as varchar) || ' (pts_time:' || cast(event_id % 100 as varchar) || '.5)' as line from metrics) select event_id, cast(regexp_extract(line, '= ([0-9]+)', 1) as bigint) as n, cast(regexp_extract(line, 'pts_time:([0-9.]+)', 1) as double) as t from l", "metrics")
def log_values(v):
    line = F.concat(F.lit("I0101 ] Registered images = "), (F.col("event_id") * 1234567 % 10000000).cast("string"), F.lit(" (pts_time:"), (F.col("event_id") % 100).cast("string"), F.lit(".5)"))
    return v.metrics.select("event_id", F.regexp_extract(line, "= ([0-9]+)", 1).cast("bigint").alias("n"), F.regexp_extract(line, "pts_time:([0-9.]+)", 1).cast("double").alias("t"))


@query(" select state, cast(round(100 * (pos - 1) / 3e0, 0) as int) as done from (values ('QUEUED', 1), ('VOXELIZING', 2), ('GENERATING_WORLD', 3), ('READY', 4)) as t(state, pos)")
def export_progress(v):
    s = v.spark.createDataFrame([(x,) for x in L.EXPORT_STEPS], "state string")
    return s.select("state", L.progress(F.col("state"), L.EXPORT_STEPS).alias("done"))


@query(" select stage, status, count(*) as n, sum(count(*)) over (partition by stage) as total from metrics group by 1, 2".replace("sum(count(*)) over (partition by stage)", "cast(sum(count(*)) over (partition by stage) as bigint)"), "metrics")
def label_distribution(v):
    return v.metrics.groupBy("stage", "status").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("stage")))
