"""Bounds under transforms, projections, frusta, crops and poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions.geometry import camera_centre, quarter_turns, quaternion_rotation, rigid, unproject, yaw_fold
from voxelith.operators.frames import visible
from voxelith.plans.queries import query


@query(", b as (select okey % 10 as g, min(xi) a, max(xi) b, min(yi) c, max(yi) d, min(zi) e, max(zi) f from points group by 1), k as (select g, x, y, z from (select g, unnest([a, b]) as x, c, d, e, f from b), unnest([c, d]) as p(y), unnest([e, f]) as q(z)) select g, min(z) as min_x, max(z) as max_x, min(y) as min_y, max(y) as max_y, min(-x) as min_z, max(-x) as max_z from k group by 1", "points")
def transformed_bounds(v):
    b = v.points.groupBy((F.col("okey") % 10).alias("g")).agg(*(F.array(F.min(f"{n}i"), F.max(f"{n}i")).alias(n) for n in "xyz"))
    for n in "xyz":
        b = b.withColumn(n, F.explode(n))
    r = [c.cast("int") for c in rigid(*map(F.col, "xyz"), quarter_turns(0, 1, 0))]
    b = b.select("g", *(c.alias(n) for c, n in zip(r, "xyz", strict=True)))
    return b.groupBy("g").agg(*(f(n).alias(f"{k}_{n}") for n in "xyz" for k, f in (("min", F.min), ("max", F.max))))


@query(", c as (select rig, cam, x, y, z from cameras), s as (select c.cam, p.pid, p.xi - c.x as dx, p.yi - c.y as dy, p.zi - c.z as dz from c join points p on p.okey % 25 = c.rig where p.zi - c.z > 0) select cam, cast(floor(50 * dx / dz + 32) as int) as u, cast(floor(50 * dy / dz + 24) as int) as v, arg_min(pid, {'d': dz, 'p': pid}) as pid, min(dz) as depth from s where floor(50 * dx / dz + 32) between 0 and 63 and floor(50 * dy / dz + 24) between 0 and 47 group by 1, 2, 3", "cameras", "points")
def visible_points(v):
    p = v.points.select((F.col("okey") % 25).alias("rig"), "pid", *(F.col(f"{n}i").alias(n) for n in "xyz"))  # each point was taken by the cameras of one rig
    return visible(p, v.cameras, "pid", "cam", "rig", (50.0, 50.0), (32.0, 24.0), (64, 48))


@query(", k as (select event_id, event_id % 97 as point, cast(event_id % 12 as int) as u, cast(event_id % 7 as int) as v, job from metrics), p as (select cam as point, z + 1 as depth from cameras) select job % 8 as image, v, u, arg_max(depth, event_id) as depth from k join p using (point) group by 1, 2, 3", "metrics", "cameras")
def keypoint_depths(v):
    k = v.metrics.select("event_id", (F.col("event_id") % 97).alias("point"), (F.col("event_id") % 12).cast("int").alias("u"), (F.col("event_id") % 7).cast("int").alias("v"), (F.col("job") % 8).alias("image"))
    p = v.cameras.select(F.col("cam").alias("point"), (F.col("z") + 1).alias("depth"))
    return k.join(p, "point").groupBy("image", "v", "u").agg(F.max_by("depth", "event_id").alias("depth"))


@query(" select cam, least(x, x + min(u)) as min_x, greatest(x, x + max(u)) as max_x, least(y, y + min(w)) as min_y, greatest(y, y + max(w)) as max_y, z as min_z, z + 10 as max_z from (select cam, x, y, z, (a * 64 - 32) / 50e0 * 10 as u, (b * 48 - 24) / 50e0 * 10 as w from cameras, unnest([0, 1]) as p(a), unnest([0, 1]) as q(b)) group by cam, x, y, z", "cameras")
def frustum_boxes(v):
    c = v.cameras.withColumn("u", F.explode(F.array(F.lit(0.0), F.lit(64.0)))).withColumn("w", F.explode(F.array(F.lit(0.0), F.lit(48.0))))
    px, py, _ = unproject(F.col("u"), F.col("w"), F.lit(10.0), F.lit(50.0), F.lit(50.0), F.lit(32.0), F.lit(24.0))
    c = c.withColumns({"px": F.col("x") + px, "py": F.col("y") + py})
    return c.groupBy("cam", "x", "y", "z").agg(F.min("px").alias("a"), F.max("px").alias("b"), F.min("py").alias("c"), F.max("py").alias("d")).select(
        "cam", F.least("x", "a").alias("min_x"), F.greatest("x", "b").alias("max_x"), F.least("y", "c").alias("min_y"), F.greatest("y", "d").alias("max_y"), F.col("z").alias("min_z"), (F.col("z") + 10).alias("max_z")
    )


@query(", q as (select cam, x, y, z, 0.6e0 as w, 0.8e0 * (cam % 2) as a, 0.8e0 * (1 - cam % 2) as b from cameras) select cam, round(-((1 - 2 * b * b) * x + 2 * a * b * y - 2 * w * b * z), 6) as cx, round(-(2 * a * b * x + (1 - 2 * a * a) * y + 2 * w * a * z), 6) as cy, round(-(2 * w * b * x - 2 * w * a * y + (1 - 2 * (a * a + b * b)) * z), 6) as cz from q", "cameras")
def camera_centres(v):
    odd = (F.col("cam") % 2).cast("double")
    r = quaternion_rotation(F.lit(0.6), 0.8 * odd, 0.8 * (1 - odd), F.lit(0.0))
    return v.cameras.select("cam", *(F.round(c, 6).alias(f"c{n}") for c, n in zip(camera_centre(r, *map(F.col, "xyz")), "xyz", strict=True)))


@query(" select o_orderkey as job, greatest(0, least(lo, hi)) as lo, greatest(greatest(0, least(lo, hi)), least(10, hi)) as hi, lo >= -1e-6 and hi <= 10 + 1e-6 as inside from (select o_orderkey, cast(o_orderkey % 13 - 2 as double) as lo, cast(o_orderkey % 17 - 1 as double) as hi from orders)")
def crop_limits(v):
    o = v.table("orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 13 - 2).cast("double").alias("a"), (F.col("o_orderkey") % 17 - 1).cast("double").alias("b"))
    lo = F.greatest(F.lit(0.0), F.least("a", "b"))
    return o.select("job", lo.alias("lo"), F.greatest(lo, F.least(F.lit(10.0), F.col("b"))).alias("hi"), ((F.col("a") >= -1e-6) & (F.col("b") <= 10 + 1e-6)).alias("inside"))


@query(" select cam, ((x * 10 + 45) % 90 + 90) % 90 - 45 as yaw from cameras", "cameras")
def folded_yaw(v):
    return v.cameras.select("cam", yaw_fold(F.col("x") * 10).alias("yaw"))


@query(" select cast(okey % 5 as bigint) as g, round(100 * count(*) filter (xi between 20 and 150 and yi between 10 and 80) / cast(count(*) as double), 6) as kept from points group by 1", "points")
def kept_percent(v):
    return v.points.groupBy((F.col("okey") % 5).alias("g")).agg(F.round(100 * F.count_if(F.col("xi").between(20, 150) & F.col("yi").between(10, 80)) / F.count("*"), 6).alias("kept"))
