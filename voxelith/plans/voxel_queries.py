"""Voxelisation: crop, cells, statistics, medians, palette, rays."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions.aggregates import lower_median
from voxelith.functions.color import lab_of_srgb8, to_linear, to_srgb8
from voxelith.functions.geometry import finite, quarter_turns, rigid, rotate
from voxelith.functions.grid import in_grid, linear_key
from voxelith.operators.voxelize import accept_cells, carved_cells, crop_to_grid, drop_isolated, match_palette, ray_cells, splat, weighted_cells
from voxelith.plans.queries import query

LOW, HIGH, SIZE = (0.0, 0.0, 0.0), (19.9, 9.9, 5.0), 0.5
DIMS = (40, 20, 10)
ROT = quarter_turns(0, 1, 0)

_IX = ", ".join(
    f"cast(least(floor(case when abs({c} / 0.5e0 - round_even({c} / 0.5e0, 0)) <= 2e-6 then round_even({c} / 0.5e0, 0) else {c} / 0.5e0 end), {d - 1}) as int) as i{c}" for c, d in zip("xyz", DIMS, strict=True)
)
GRID = f", grid as (select *, {_IX} from points where x between 0 and 19.9e0 and y between 0 and 9.9e0 and z between 0 and 5)"
ACC = GRID + """, acc as (select ix, iy, iz, count(*) as n, count(distinct view_id) as views,
  min(sqrt((x - (ix + 0.5e0) * 0.5e0) * (x - (ix + 0.5e0) * 0.5e0) + (y - (iy + 0.5e0) * 0.5e0) * (y - (iy + 0.5e0) * 0.5e0) + (z - (iz + 0.5e0) * 0.5e0) * (z - (iz + 0.5e0) * 0.5e0))) as nearest,
  quantile_disc(red, 0.5) as med_r, quantile_disc(green, 0.5) as med_g, quantile_disc(blue, 0.5) as med_b
  from grid group by ix, iy, iz having count(*) >= 2)"""
_LIN = "case when {c} / 255e0 <= 0.04045e0 then {c} / 255e0 / 12.92e0 else pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end"
_F = "case when {t} > 216 / 24389e0 then cbrt({t}) else (24389 / 27e0 * ({t}) + 16) / 116 end"


def lab_sql(source: str, r: str, g: str, b: str, keep: str) -> str:
    """Lab columns lab_l, lab_a, lab_b of 8-bit columns."""
    return f"""select {keep}, 116 * fy - 16 as lab_l, 500 * (fx - fy) as lab_a, 200 * (fy - fz) as lab_b from (
      select {keep}, {_F.format(t='xx')} as fx, {_F.format(t='yy')} as fy, {_F.format(t='zz')} as fz from (
        select {keep}, (0.4124564e0 * lr + 0.3575761e0 * lg + 0.1804375e0 * lb) / 0.95047e0 as xx, 0.2126729e0 * lr + 0.7151522e0 * lg + 0.0721750e0 * lb as yy,
               (0.0193339e0 * lr + 0.1191920e0 * lg + 0.9503041e0 * lb) / 1.08883e0 as zz from (
          select {keep}, {_LIN.format(c=r)} as lr, {_LIN.format(c=g)} as lg, {_LIN.format(c=b)} as lb from {source})))"""


MATCH = f""", cl as ({lab_sql('(select distinct med_r, med_g, med_b from acc)', 'med_r', 'med_g', 'med_b', 'med_r, med_g, med_b')}),
 pl as ({lab_sql('palette', 'pr', 'pg', 'pb', 'pos, palette_id, block_state, penalty')}),
 best as (select med_r, med_g, med_b, arg_min(palette_id, score) as palette_id, arg_min(block_state, score) as block_state from (
   select cl.med_r, cl.med_g, cl.med_b, palette_id, block_state, {{'s': round(sqrt((cl.lab_l - pl.lab_l) ** 2 + (cl.lab_a - pl.lab_a) ** 2 + (cl.lab_b - pl.lab_b) ** 2) + penalty, 9), 'p': pos}} as score
   from cl, pl) group by med_r, med_g, med_b)"""


def _grid(v):
    return crop_to_grid(v.points.drop("support"), LOW, HIGH, SIZE)[0]


def _accepted(v):
    return accept_cells(_grid(v), LOW, SIZE, min_points=2)


@query(ACC + MATCH + " select ix, iy, iz, n, views, round(nearest, 6) as nearest, med_r, med_g, med_b, palette_id, block_state from acc join best using (med_r, med_g, med_b)", "points", "palette")
def voxelize_palette(v):
    out = match_palette(_accepted(v), v.palette)
    return out.select("ix", "iy", "iz", "n", "views", F.round("nearest", 6).alias("nearest"), "med_r", "med_g", "med_b", "palette_id", "block_state")


@query(GRID + """, run as (select ix, iy, iz, red, pid, weight, sum(weight) over (partition by ix, iy, iz order by red, pid rows unbounded preceding) as c, sum(weight) over (partition by ix, iy, iz) as t from grid)
 select ix, iy, iz, arg_min(red, {'r': red, 'p': pid}) as wmed_red from run where 2 * c >= t group by ix, iy, iz""", "points")
def voxel_weighted_median(v):
    return weighted_cells(_grid(v), "red", "weight", ["pid"])


@query(GRID + " select ix, iy, iz, count(*) as n, max(support) as views from grid group by ix, iy, iz having count(*) >= 3 and max(support) >= 5", "points")
def voxel_support_threshold(v):
    cropped = crop_to_grid(v.points.drop("view_id"), LOW, HIGH, SIZE)[0]
    return accept_cells(cropped, LOW, SIZE, min_points=3, min_views=5).select("ix", "iy", "iz", "n", "views")


@query(GRID + " select * from (select ix, iy, iz, round(avg(least(greatest(confidence, 0), 1)), 6) as confidence from grid group by ix, iy, iz) where confidence >= 0.95", "points")
def voxel_confidence(v):
    out = accept_cells(_grid(v), LOW, SIZE, min_points=1)
    return out.select("ix", "iy", "iz", F.round("confidence", 6).alias("confidence")).where("confidence >= 0.95")


@query(GRID + ", free as (select distinct ix, iy, iz from grid where (ix * 7 + iy * 3 + iz) % 17 = 0 union all select 1000, 0, 0) select ix, iy, iz, count(*) as n from grid g where not exists (select 1 from free f where f.ix = g.ix and f.iy = g.iy and f.iz = g.iz) group by ix, iy, iz having count(*) >= 2", "points")
def voxel_free_cells(v):
    g = _grid(v)
    free = g.where("(ix * 7 + iy * 3 + iz) % 17 = 0").select("ix", "iy", "iz").distinct().union(v.spark.createDataFrame([(1000, 0, 0)], "ix int, iy int, iz int"))
    return accept_cells(g, LOW, SIZE, min_points=2, free=free, dims=DIMS).select("ix", "iy", "iz", "n")


@query(ACC + ", strong as (select * from acc where n >= 9) select ix, iy, iz, n from strong a where exists (select 1 from strong b where abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1)", "points")
def voxel_isolated_removal(v):
    return drop_isolated(accept_cells(_grid(v), LOW, SIZE, min_points=9)).select("ix", "iy", "iz", "n")


@query(GRID + ", m as (select min(ix) a, max(ix) b, min(iy) c, max(iy) d, min(iz) e, max(iz) f from grid) select ix, iy, iz, cast(ix - round_even((a + b) / 2e0, 0) as int) as x, iy - c as y, cast(iz - round_even((e + f) / 2e0, 0) as int) as z from (select distinct ix, iy, iz from grid), m", "points")
def voxel_centring(v):
    from voxelith.operators.world import centring

    cells = _grid(v).select("ix", "iy", "iz").distinct()
    return cells.crossJoin(F.broadcast(centring(cells))).select("ix", "iy", "iz", (F.col("ix") + F.col("t_ix")).alias("x"), (F.col("iy") + F.col("t_iy")).alias("y"), (F.col("iz") + F.col("t_iz")).alias("z"))


@query(" select pid, round(z + 1.5e0, 6) as x, round(y - 2, 6) as y, round(-x + 0.25e0, 6) as z, nz as nx, ny, -nx as nz from points", "points")
def transform_points(v):
    m = [[*map(float, r[:3]), t] for r, t in zip(ROT[:3], (1.5, -2.0, 0.25), strict=True)] + [[0, 0, 0, 1]]
    p, n = rigid(*map(F.col, "xyz"), m), rotate(F.col("nx"), F.col("ny"), F.col("nz"), m)
    return v.points.select("pid", *(F.round(c, 6).alias(a) for c, a in zip(p, "xyz", strict=True)), *((c + 0.0).alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)))


@query(f", c as ({lab_sql('(select distinct red, green, blue from points)', 'red', 'green', 'blue', 'red, green, blue')}) select red, green, blue, round(lab_l, 6) as lab_l, round(lab_a, 6) as lab_a, round(lab_b, 6) as lab_b from c", "points")
def color_lab(v):
    lab = lab_of_srgb8(*map(F.col, ("red", "green", "blue")))
    return v.points.select("red", "green", "blue").distinct().select("red", "green", "blue", *(F.round(c, 6).alias(f"lab_{n}") for c, n in zip(lab, "lab", strict=True)))


@query(" select distinct red, red as back from points", "points")
def color_round_trip(v):
    return v.points.select("red").distinct().select("red", to_srgb8(to_linear(F.col("red") / 255.0)).alias("back"))


@query(" select pid, (cast(xi as bigint) * 100 + yi) * 60 + zi as key from points where xi < 100 and yi < 50 and zi < 40", "points")
def linear_cell_keys(v):
    return v.points.where(in_grid((100, 50, 40), ("xi", "yi", "zi"))).select("pid", linear_key(F.col("xi"), F.col("yi"), F.col("zi"), 100, 60).alias("key"))


@query(" select count(*) as total, count(*) filter (okey % 13 <> 0) as finite from points", "points")
def finite_filter(v):
    x = F.when(F.col("okey") % 13 == 0, F.when(F.col("okey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("x"))
    return v.points.select(x.alias("x")).agg(F.count("*").alias("total"), F.count_if(finite(F.col("x"))).alias("finite"))


@query(GRID + ", a as (select ix, iy, iz, count(*) n from grid group by ix, iy, iz) select (select count(*) from points) as input, (select count(*) from grid) as cropped, (select count(*) from a) as cells, (select count(*) from a where n >= 3) as accepted, (select count(*) from a where n < 3) as rejected", "points")
def reject_counters(v):
    p = v.points
    inside = F.col("x").between(0, 19.9) & F.col("y").between(0, 9.9) & F.col("z").between(0, 5)
    a = p.agg(F.count("*").alias("input"), F.count_if(inside).alias("cropped"))
    b = _grid(v).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n")).agg(F.count("*").alias("cells"), F.count_if(F.col("n") >= 3).alias("accepted"), F.count_if(F.col("n") < 3).alias("rejected"))
    return a.crossJoin(F.broadcast(b))


@query(""", r as (select cam as ray, x as ox, y as oy, z as oz, cast(x + cam % 5 - 2 as double) + 0.5e0 as x, y + 3.25e0 as y, z - cast(cam % 7 as double) - 0.5e0 as z from cameras),
 n as (select *, cast(greatest(1, ceil(2 * greatest(abs(x - ox), abs(y - oy), abs(z - oz)) / 1e0)) as int) as n from r)
 select distinct ray, cast(floor(ox + (x - ox) * (i / cast(n as double))) as int) as ix, cast(floor(oy + (y - oy) * (i / cast(n as double))) as int) as iy, cast(floor(oz + (z - oz) * (i / cast(n as double))) as int) as iz
 from n, unnest(range(0, n)) as u(i)
 where not (floor(ox + (x - ox) * (i / cast(n as double))) = floor(x) and floor(oy + (y - oy) * (i / cast(n as double))) = floor(y) and floor(oz + (z - oz) * (i / cast(n as double))) = floor(z))""", "cameras")
def ray_carving(v):
    c = F.col("cam")
    rays = v.cameras.select(c.alias("ray"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), (F.col("x") + c % 5 - 2 + 0.5).alias("x"), (F.col("y") + 3.25).alias("y"), (F.col("z") - c % 7 - 0.5).alias("z"))
    return ray_cells(rays, 1.0)


@query(""", r as (select x as ox, y as oy, z as oz, cast(x + cam % 5 - 2 as double) + 0.5e0 as x, y + 3.25e0 as y, z - cast(cam % 7 as double) - 0.5e0 as z from cameras),
 n as (select *, cast(greatest(1, ceil(2 * greatest(abs(x - ox), abs(y - oy), abs(z - oz)) / 1e0)) as int) as n from r),
 f as (select distinct cast(floor(ox + (x - ox) * (i / cast(n as double))) as int) as ix, cast(floor(oy + (y - oy) * (i / cast(n as double))) as int) as iy, cast(floor(oz + (z - oz) * (i / cast(n as double))) as int) as iz from n, unnest(range(0, n)) as u(i)
   where not (floor(ox + (x - ox) * (i / cast(n as double))) = floor(x) and floor(oy + (y - oy) * (i / cast(n as double))) = floor(y) and floor(oz + (z - oz) * (i / cast(n as double))) = floor(z)))
 select ix, iy, iz from f where ix between 0 and 39 and iy between 0 and 19 and iz between 0 and 29 and not exists (select 1 from cells c where c.ix = f.ix and c.iy = f.iy and c.iz = f.iz)""", "cameras", "cells")
def carved_free_space(v):
    """Cells that rays cross, without those that are observed."""
    c = F.col("cam")
    rays = v.cameras.select(c.alias("ray"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), (F.col("x") + c % 5 - 2 + 0.5).alias("x"), (F.col("y") + 3.25).alias("y"), (F.col("z") - c % 7 - 0.5).alias("z"))
    return carved_cells(rays, 1.0, v.cells, (40, 20, 30))


@query(GRID + """ select distinct pid, ix + a as ix, iy + b as iy, iz + c as iz from grid, unnest([-1, 0, 1]) as p(a), unnest([-1, 0, 1]) as q(b), unnest([-1, 0, 1]) as r(c)
 where (a = 0 and b = 0 and c = 0 or (x / 0.5e0 - (ix + a + 0.5e0)) ** 2 + (y / 0.5e0 - (iy + b + 0.5e0)) ** 2 + (z / 0.5e0 - (iz + c + 0.5e0)) ** 2 <= 0.8e0 * 0.8e0 - 1e-3)""", "points")
def splat_candidates(v):
    return splat(_grid(v), LOW, SIZE, (0.64 - 1e-3) ** 0.5, "pid")


@query(" select red % 16 as k, quantile_disc(blue, 0.5) as low, median(blue) as mid, quantile_cont(blue, 0.25) as q25 from points group by 1", "points")
def medians(v):
    return v.points.groupBy((F.col("red") % 16).alias("k")).agg(lower_median("blue").alias("low"), F.median("blue").alias("mid"), F.expr("percentile(blue, 0.25)").alias("q25"))


@query(" select cast(turn as int) as turn, x, y, z, case turn when 0 then x when 1 then z when 2 then -x else -z end as rx, y as ry, case turn when 0 then z when 1 then -x when 2 then -z else x end as rz from (select distinct xi as x, yi as y, zi as z from points), unnest([0, 1, 2, 3]) as t(turn)", "points")
def quarter_turn_points(v):
    p = v.points.select(F.col("xi").alias("x"), F.col("yi").alias("y"), F.col("zi").alias("z")).distinct()
    out = None
    for t in range(4):
        m = quarter_turns(0, t, 0)
        r = [sum((F.col(n) * F.lit(m[i][j]) for j, n in enumerate("xyz")), F.lit(0)).cast("int") for i in range(3)]
        part = p.select(F.lit(t).alias("turn"), "x", "y", "z", *(c.alias(f"r{n}") for c, n in zip(r, "xyz", strict=True)))
        out = part if out is None else out.union(part)
    return out


@query(" select o_orderkey as job, cast(greatest(1, ceil(a / s - 1e-12)) * greatest(1, ceil(b / s - 1e-12)) * greatest(1, ceil(c / s - 1e-12)) as bigint) as blocks, greatest(1, ceil(a / s - 1e-12)) * greatest(1, ceil(b / s - 1e-12)) * greatest(1, ceil(c / s - 1e-12)) > 20000 as warn from (select o_orderkey, 1 + o_orderkey % 7 as a, 1 + o_orderkey % 5 as b, 1 + o_orderkey % 3 as c, greatest(1 + o_orderkey % 7, 1 + o_orderkey % 5, 1 + o_orderkey % 3) / 64e0 as s from orders)")
def block_estimates(v):
    o = v.table("orders")
    ext = {n: 1 + F.col("o_orderkey") % m for n, m in (("a", 7), ("b", 5), ("c", 3))}
    df = o.select("o_orderkey", *(e.alias(n) for n, e in ext.items())).withColumn("s", F.greatest("a", "b", "c") / 64.0)
    dims = [F.greatest(F.lit(1), F.ceil(F.col(n) / F.col("s") - 1e-12)) for n in "abc"]
    n = (dims[0] * dims[1] * dims[2]).cast("bigint")
    return df.select(F.col("o_orderkey").alias("job"), n.alias("blocks"), (n > 20000).alias("warn"))


@query(" select palette_id, count(*) as n, count(distinct block_state) as states from palette where penalty >= 0 and palette_id > 0 and starts_with(block_state, 'minecraft:') group by palette_id having count(*) = 1", "palette")
def palette_checks(v):
    p = v.palette.where((F.col("penalty") >= 0) & (F.col("palette_id") > 0) & F.col("block_state").startswith("minecraft:"))
    return p.groupBy("palette_id").agg(F.count("*").alias("n"), F.count_distinct("block_state").alias("states")).where("n = 1")


@query(ACC + MATCH + " select coalesce(p.block_state, concat('unknown:', cast(id as varchar))) as label, count(*) as n from (select case when palette_id % 5 = 0 then palette_id + 100000 else palette_id end as id from acc join best using (med_r, med_g, med_b)) c left join palette p on p.palette_id = c.id group by 1", "points", "palette")
def palette_distribution(v):
    c = match_palette(_accepted(v), v.palette).select(F.when(F.col("palette_id") % 5 == 0, F.col("palette_id") + 100000).otherwise(F.col("palette_id")).alias("id"))
    p = v.palette.select(F.col("palette_id").alias("id"), "block_state")
    return c.groupBy("id").agg(F.count("*").alias("n")).join(F.broadcast(p), "id", "left").select(F.coalesce("block_state", F.concat(F.lit("unknown:"), F.col("id").cast("string"))).alias("label"), "n")
