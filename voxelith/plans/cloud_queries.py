"""Neighbourhoods, outliers, provenance, samples, histograms and robust statistics of clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions.aggregates import mad, robust_affine
from voxelith.operators.cloud import bounds, circular_peak, density_filter, every_kth, floor_layer, gaussian_taps, histogram_peak, mean_distance, moments, outlier_filter, preview_sample, tilt_search, unless_abandoned
from voxelith.operators.neighbors import nearest, nearest_folded, neighbour_counts, tag_near, tag_within
from voxelith.plans.queries import query

XYZ = ("xi", "yi", "zi")
D2 = "(a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) + (a.zi - b.zi) * (a.zi - b.zi)"


def _near_sql(cell: int) -> str:
    """far: every point under each of the 27 cells around its own."""
    return f", far as (select pid, xi, yi, zi, xi // {cell} + i as cx, yi // {cell} + j as cy, zi // {cell} + k as cz from points, unnest([-1, 0, 1]) as p(i), unnest([-1, 0, 1]) as q(j), unnest([-1, 0, 1]) as r(k))"


def _near_on(cell: int) -> str:
    return f"a.xi // {cell} = b.cx and a.yi // {cell} = b.cy and a.zi // {cell} = b.cz"


@query(", c as (select xi // 5 as cx, yi // 5 as cy, zi // 5 as cz, count(*) as own from points group by 1, 2, 3) select a.cx, a.cy, a.cz, a.own, cast(sum(b.own) as bigint) as around from c a join c b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and abs(a.cz - b.cz) <= 1 group by 1, 2, 3, 4", "points")
def neighbourhood_counts(v):
    return neighbour_counts(v.points, 5, XYZ).toDF("cx", "cy", "cz", "own", "around")


@query(_near_sql(3) + ", r as (select distinct cx, cy, cz from far join points using (pid) where view_id = 1) select pid, case when r.cx is null then 0 else 1 end as observed from points a left join r on a.xi // 3 = r.cx and a.yi // 3 = r.cy and a.zi // 3 = r.cz", "points")
def provenance(v):
    return tag_near(v.points, v.points.where("view_id = 1"), 3, xyz=XYZ).select("pid", "observed")


@query(_near_sql(3) + f" select a.pid, count(*) as neighbours from points a join far b on {_near_on(3)} where {D2} <= 9 group by a.pid having count(*) >= 3", "points")
def density(v):
    from voxelith.operators.neighbors import within

    return within(v.points, v.points, 3, "pid", XYZ).where("neighbours >= 3")


@query(_near_sql(2) + f", keep as (select a.pid from points a join far b on {_near_on(2)} where {D2} <= 4 group by a.pid having count(*) >= 3) select pid from points where (select count(*) from keep) < 0.5 * (select count(*) from points) or pid in (select pid from keep)", "points")
def density_or_abandon(v):
    return unless_abandoned(v.points, density_filter(v.points, 2, "pid", 3, XYZ), "pid").select("pid")


def _knn_sql(cell: int, k: int, left: str = "points", right: str = "points", extra: str = "b.pid as b", on: str = "") -> str:
    """d (a, b, d2, rank): each left row's donors in order, from the 27 cells around it, or from all where these hold fewer than k within reach."""
    also = f"and a.{on} = b.{on}" if on else ""
    return f""", give as (select *, xi // {cell} + i as cx, yi // {cell} + j as cy, zi // {cell} + k as cz from {right}, unnest([-1, 0, 1]) as p(i), unnest([-1, 0, 1]) as q(j), unnest([-1, 0, 1]) as r(k)),
 close as materialized (select a.pid as a, {extra}, {D2} as d2 from {left} a join give b on {_near_on(cell)} {also} where {D2} <= {cell * cell}),
 few as materialized (select pid from {left} where pid not in (select a from close group by a having count(*) >= {k})),
 tried as (select * from close where a not in (select pid from few) union all select a.pid as a, {extra}, {D2} as d2 from {left} a join {right} b on true {also} where a.pid in (select pid from few)),
 d as (select *, row_number() over (partition by a order by d2, b) as rank from tried)"""


KNN = _knn_sql(10, 8) + ", means as (select a as pid, sum(sqrt(d2)) / count(*) as mean_d from d where rank <= 8 group by a)"


@query(KNN + " select pid, round(mean_d, 6) as mean_d from means", "points")
def knn_mean_distance(v):
    return mean_distance(v.points, "pid", 8, 3, XYZ).select("pid", F.round("mean_d", 6).alias("mean_d"))


@query(KNN + ", m as (select median(mean_d) as med from means), k as (select median(abs(mean_d - med)) as mad from means, m) select pid from means, m, k where mean_d <= med + 2 * greatest(mad, 1e-15)", "points")
def mad_outliers(v):
    return outlier_filter(mean_distance(v.points, "pid", 8, 3, XYZ), 2.0).select("pid")


@query(_near_sql(3) + f", hit as (select distinct a.pid from points a join far b on {_near_on(3)} join points o on o.pid = b.pid where o.view_id = 2 and {D2} <= 9) select a.pid, hit.pid is not null as near from points a left join hit on hit.pid = a.pid", "points")
def nearest_within(v):
    return tag_within(v.points, v.points.where("view_id = 2"), 3, "pid", "near", XYZ)


@query(_knn_sql(15, 12, right="(select * from points where view_id = 3)", extra="b.pid as b, b.red as red") + " select a as pid, round(sum(red / greatest(d2, 1e0)) / sum(1 / greatest(d2, 1e0)), 6) as red from d where rank <= 12 group by a", "points")
def inverse_distance_colour(v):
    w = 1 / F.greatest(F.col("d2"), F.lit(1.0))
    mean = F.round(F.sum(F.col("red") * w) / F.sum(w), 6).alias("red")
    return nearest_folded(v.points, v.points.where("view_id = 3"), 12, 6, "pid", [mean], XYZ, ("red",)).withColumnRenamed("a", "pid")


@query(", kinds as (select *, case when ny > 0.7 then 'floor' when ny < -0.7 then 'ceiling' else 'wall' end as kind from points)" + _knn_sql(15, 1, left="kinds", right="(select * from kinds where view_id = 4)", on="kind") + " select a as pid, b as donor from d where rank = 1", "points")
def same_kind_nearest(v):
    kind = F.when(F.col("ny") > 0.7, "floor").when(F.col("ny") < -0.7, "ceiling").otherwise("wall")
    p = v.points.withColumn("kind", kind)
    return nearest(p, p.where("view_id = 4"), 1, 4, "pid", XYZ, on=("kind",)).select(F.col("a").alias("pid"), F.col("b").alias("donor"))


@query(" select min(xi) as min_xi, max(xi) as max_xi, min(yi) as min_yi, max(yi) as max_yi, min(zi) as min_zi, max(zi) as max_zi, round(sqrt((max(xi) - min(xi)) ** 2 + (max(yi) - min(yi)) ** 2 + (max(zi) - min(zi)) ** 2), 6) as diagonal from points", "points")
def cloud_bounds(v):
    return bounds(v.points, XYZ).withColumn("diagonal", F.round("diagonal", 6))


@query(", o as (select pid, row_number() over (order by xi, yi, zi, pid) - 1 as rn, count(*) over () as n from points) select pid, red, support from o join points using (pid) where rn in (select distinct cast(floor(i * (n - 1) / 499e0) as bigint) from (select max(n) as n from o), unnest(range(0, 500)) as u(i))", "points")
def sampled_preview(v):
    return preview_sample(v.points, 500, ["xi", "yi", "zi", "pid"]).select("pid", "red", "support")


@query(", o as (select pid, row_number() over (order by pid) - 1 as rn, red, support from points) select pid, red, support from o where rn % 37 = 0", "points")
def systematic_sample(v):
    return every_kth(v.points, 37, ["pid"]).select("pid", "red", "support")


@query(", h as (select cast(floor(zi / 3e0) as int) as bin, count(*) as n from points group by 1), c as (select *, sum(n) over (order by bin) as c, sum(n) over () as t from h) select arg_max(bin, {'n': n, 'b': -bin}) as bin, max(n) as n from c where 1 - c / cast(t as double) >= 0.3", "points")
def floor_peak(v):
    return histogram_peak(v.points, "zi", 3.0, 0.3)


@query(", t as (select (a + 4) * 9 + b + 4 as tilt, a / 8e0 as tx, b / 8e0 as tz from unnest(range(-4, 5)) as p(a), unnest(range(-4, 5)) as q(b)), h as (select tilt, floor((yi + xi * tx + zi * tz) / 2) as bin, count(*) as n from points, t group by 1, 2), m as (select tilt, max(n) as n from h group by 1) select cast(arg_max(tilt, {'n': n, 't': -tilt}) as bigint) as tilt, max(n) as n from m", "points")
def tilt_grid(v):
    s = v.spark
    t = s.range(81).select(F.col("id").alias("tilt"), ((F.floor(F.col("id") / 9) - 4) / 8.0).alias("tx"), ((F.col("id") % 9 - 4) / 8.0).alias("tz"))
    p = v.points.select(F.col("xi").alias("x"), F.col("yi").alias("y"), F.col("zi").alias("z"))
    return tilt_search(p, t, 2.0)


@query(", h as (select (xi * 17 + yi) % 360 as b, sum(weight) as w from points group by 1), k as (select * from (values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) as t(o, k)), s as (select (b + o + 360) % 360 as bin, sum(w * k) as s from h, k group by 1) select cast(arg_max(bin, {'s': s, 'b': -bin}) as int) as bin, cast(max(s) as bigint) as s from s", "points")
def circular_histogram(v):
    p = v.points.select(((F.col("xi") * 17 + F.col("yi")) % 360).cast("int").alias("b"), "weight")
    return circular_peak(p, "b", "weight", [(-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)])


@query(", h as (select yi as layer, count(*) as n from points where ny > 0.85 group by 1), s as (select layer + o as layer, sum(n) as s from h, unnest([-1, 0, 1]) as t(o) group by 1) select min(layer) as layer, cast(arg_min(s, layer) as bigint) as s from s where s >= 0.3 * (select max(s) from s)", "points")
def floor_layers(v):
    return floor_layer(v.points.where("ny > 0.85"), "yi")


@query(" select count(*) as n, sum(xi) as s_xi, sum(yi) as s_yi, sum(zi) as s_zi, sum(xi * xi) as s_xixi, sum(xi * yi) as s_xiyi, sum(xi * zi) as s_xizi, sum(yi * yi) as s_yiyi, sum(yi * zi) as s_yizi, sum(zi * zi) as s_zizi from points".replace("sum(", "cast(sum(").replace(") as s_", ") as bigint) as s_"), "points")
def covariance_moments(v):
    return moments(v.points, XYZ)


def _fit_sql(rounds: int) -> str:
    """f0 to f<rounds - 1>: fits of the rows kept so far; k0 onwards: which are kept by their residuals' median."""
    fit = "select frame, regr_slope(depth, disparity) filter (keep) as a, regr_intercept(depth, disparity) filter (keep) as b from {0} group by 1"
    out = [", k0 as materialized (select frame, depth, disparity, true as keep from pairs)", f"f0 as materialized ({fit.format('k0')})"]
    for i in range(1, rounds):
        out.append(f"r{i} as materialized (select k.frame, depth, disparity, keep, abs(depth - (a * disparity + b)) as r from k{i - 1} k join f{i - 1} using (frame))")
        out.append(f"k{i} as materialized (select r.frame, depth, disparity, r <= 3 * 1.4826 * m + 1e-9 as keep from r{i} r join (select frame, median(r) filter (keep) as m from r{i} group by 1) using (frame))")
        out.append(f"f{i} as materialized ({fit.format(f'k{i}')})")
    return ", ".join(out) + f" select frame, round(a, 4) as slope, round(b, 3) as intercept from f{rounds - 1}"


@query(_fit_sql(4), "pairs")
def robust_fit(v):
    return robust_affine(v.pairs, ["frame"], "disparity", "depth").select("frame", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(", h as (select (xi * 17 + yi) % 360 as b, sum(weight) as w from points group by 1), k as (select o, exp(-0.5 * (o / 2e0) ** 2) as k from unnest(range(-6, 7)) as t(o)), s as (select (b + o + 360) % 360 as bin, round(sum(w * k), 3) as s from h, k group by 1) select cast(arg_max(bin, {'s': s, 'b': -bin}) as int) as bin, max(s) as s from s", "points")
def circular_gaussian(v):
    p = v.points.select(((F.col("xi") * 17 + F.col("yi")) % 360).cast("int").alias("b"), "weight")
    return circular_peak(p, "b", "weight", gaussian_taps()).withColumn("s", F.round("s", 3))


@query(", m as (select frame, median(depth) as med from pairs group by 1) select frame, med, median(abs(depth - med)) as mad from pairs join m using (frame) group by 1, 2", "pairs")
def frame_mad(v):
    return mad(v.pairs, ["frame"], "depth").select("frame", "med", "mad")


@query(", q as (select frame, quantile_cont(depth, 0.01) / 1.5e0 as lo, quantile_cont(depth, 0.99) * 1.5e0 as hi from pairs group by 1) select frame, count(*) filter (depth between lo and hi) as plausible, count(*) as n from pairs join q using (frame) group by 1 having count(*) >= 10", "pairs")
def depth_plausibility(v):
    p = v.pairs
    q = p.groupBy("frame").agg(F.expr("percentile(depth, 0.01) / 1.5").alias("lo"), F.expr("percentile(depth, 0.99) * 1.5").alias("hi"))
    return p.join(q, "frame").groupBy("frame").agg(F.count_if(F.col("depth").between(F.col("lo"), F.col("hi"))).alias("plausible"), F.count("*").alias("n")).where("n >= 10")


@query(", h as (select *, ('0x' || substr(sha256(cast(okey as varchar)), 1, 4))::int % 10 = 0 as held from pairs), f as (select frame, regr_slope(depth, disparity) as a, regr_intercept(depth, disparity) as b from h where not held group by 1) select frame, round(median(abs(a * disparity + b - depth) / depth), 6) as error, count(*) as n from h join f using (frame) where held group by 1", "pairs")
def held_out_error(v):
    h = v.pairs.withColumn("held", F.conv(F.substring(F.sha2(F.col("okey").cast("string").cast("binary"), 256), 1, 4), 16, 10).cast("int") % 10 == 0)
    f = h.where("not held").groupBy("frame").agg(F.regr_slope("depth", "disparity").alias("a"), F.regr_intercept("depth", "disparity").alias("b"))
    e = F.abs(F.col("a") * F.col("disparity") + F.col("b") - F.col("depth")) / F.col("depth")
    return h.where("held").join(f, "frame").groupBy("frame").agg(F.round(F.median(e), 6).alias("error"), F.count("*").alias("n"))


@query(" select frame, cast(floor(disparity / 8) as int) as bv, cast(floor(depth / 24) as int) as bu, sum(depth) as s, count(*) as n from pairs group by 1, 2, 3", "pairs")
def block_sums(v):
    return v.pairs.groupBy("frame", F.floor(F.col("disparity") / 8).cast("int").alias("bv"), F.floor(F.col("depth") / 24).cast("int").alias("bu")).agg(F.sum("depth").alias("s"), F.count("*").alias("n"))


@query(" select round(avg(n), 6) as mean_n, median(n) as median_n, count(*) filter (n >= 600) as completed, count(*) as frames from (select frame, count(*) as n from pairs group by 1)", "pairs")
def run_statistics(v):
    f = v.pairs.groupBy("frame").agg(F.count("*").alias("n"))
    return f.agg(F.round(F.avg("n"), 6).alias("mean_n"), F.median("n").alias("median_n"), F.count_if(F.col("n") >= 600).alias("completed"), F.count("*").alias("frames"))


@query(" select a.rig, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) as baseline from cameras a join cameras b using (rig) where a.cam < b.cam group by 1", "cameras")
def camera_baseline(v):
    c = v.cameras
    b = c.select("rig", *(F.col(n).alias(f"o{n}") for n in ("cam", "x", "y", "z")))
    d = F.sqrt(sum(((F.col(n) - F.col(f"o{n}")) * (F.col(n) - F.col(f"o{n}")) for n in "xyz"), F.lit(0.0)))
    return c.join(b, "rig").where("cam < ocam").groupBy("rig").agg(F.round(F.max(d), 6).alias("baseline"))


@query(" select sha256(block_state) as digest, length(block_state) as n from palette", "palette")
def checksums(v):
    return v.palette.select(F.sha2(F.col("block_state").cast("binary"), 256).alias("digest"), F.length("block_state").cast("bigint").alias("n"))


@query(" select pid, okey, case when okey % 2 = 0 then 1 else 0 end as observed from points union all select pid, okey, 0 from points where okey % 3 = 0", "points")
def flagged_union(v):
    p = v.points.select("pid", "okey")
    return p.withColumn("observed", F.when(F.col("okey") % 2 == 0, 1).otherwise(0)).unionByName(p.where("okey % 3 = 0").withColumn("observed", F.lit(0)))


@query(" select distinct red, green, blue from points except select distinct red, green, blue from points where okey % 4 = 0", "points")
def colour_difference(v):
    c = v.points
    return c.select("red", "green", "blue").subtract(c.where("okey % 4 = 0").select("red", "green", "blue"))
