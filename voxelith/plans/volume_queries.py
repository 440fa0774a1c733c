"""Fusion, surfaces, components, morphology and shells over sparse cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions.grid import FACES
from voxelith.operators.volume import SQUARE, closed, components, crossings, dilate, erode, fill_holes, fuse, grey_closing, largest, opened, seeded, shell
from voxelith.plans.queries import query

IX = ("ix", "iy", "iz")
_FACE = "(values " + ", ".join(str(s) for s in FACES) + ") as f(a, b, c)"
_SQ = "(values " + ", ".join(str(s) for s in SQUARE) + ") as f(a, b, c)"
FUSED = """, samples as (select cast(l_partkey % 20 as int) as ix, cast(l_suppkey % 10 as int) as iy, cast(l_quantity as int) % 12 as iz, (l_partkey % 20 * 3 + l_suppkey % 10 + l_orderkey % 3) % 9 - 4 as sdf, 3 + l_linenumber % 2 as trunc from lineitem),
 vol as (select ix, iy, iz, avg(case when sdf > -trunc then least(sdf / cast(trunc as double), 1e0) end) as tsdf, count(*) filter (sdf > -trunc) as weight, count(*) filter (sdf > trunc) as free, count(*) filter (sdf < -trunc) as occluded, count(*) filter (abs(sdf) <= trunc) as near from samples group by 1, 2, 3)"""
_WITH = "with recursive "


def _samples(v):
    c = F.col
    return v.table("lineitem").select(
        (c("l_partkey") % 20).cast("int").alias("ix"), (c("l_suppkey") % 10).cast("int").alias("iy"), (c("l_quantity").cast("int") % 12).alias("iz"),
        ((c("l_partkey") % 20 * 3 + c("l_suppkey") % 10 + c("l_orderkey") % 3) % 9 - 4).alias("sdf"), (3 + c("l_linenumber") % 2).alias("trunc"),
    )


def _volume(v):
    return fuse(_samples(v))


@query(_WITH + FUSED[2:] + " select ix, iy, iz, round(tsdf, 9) as tsdf, weight, free, occluded, near from vol")
def signed_distances(v):
    return _volume(v).withColumn("tsdf", F.round("tsdf", 9))


@query(_WITH + FUSED[2:] + """, s as (select * from vol where weight >= 3), x as (
 select 0 as axis, a.ix, a.iy, a.iz, a.tsdf as p, b.tsdf as q from s a join s b on b.ix = a.ix + 1 and b.iy = a.iy and b.iz = a.iz union all
 select 1, a.ix, a.iy, a.iz, a.tsdf, b.tsdf from s a join s b on b.ix = a.ix and b.iy = a.iy + 1 and b.iz = a.iz union all
 select 2, a.ix, a.iy, a.iz, a.tsdf, b.tsdf from s a join s b on b.ix = a.ix and b.iy = a.iy and b.iz = a.iz + 1)
 select axis, ix, iy, iz, round(p / (p - q), 6) as frac from x where p * q < 0 and abs(p - q) <= 1""")
def surface_crossings(v):
    return crossings(_volume(v)).withColumn("frac", F.round("frac", 6))


@query(_WITH + FUSED[2:] + " select ix, iy, iz from vol where free >= 2 and free >= 0.5 * (free + occluded)")
def free_space(v):
    return _volume(v).where("free >= 2 and free >= 0.5 * (free + occluded)").select(*IX)


@query(_WITH + FUSED[2:] + " select a.ix, a.iy, a.iz, round(coalesce(b.tsdf, 1e0) - coalesce(c.tsdf, 1e0), 6) as gx from vol a left join vol b on b.ix = a.ix + 1 and b.iy = a.iy and b.iz = a.iz left join vol c on c.ix = a.ix - 1 and c.iy = a.iy and c.iz = a.iz where a.weight >= 3")
def volume_gradient(v):
    vol = _volume(v)
    side = lambda d, n: vol.select((F.col("ix") - d).alias("ix"), "iy", "iz", F.col("tsdf").alias(n))
    out = vol.where("weight >= 3").select(*IX).join(side(1, "p"), list(IX), "left").join(side(-1, "q"), list(IX), "left")
    return out.select(*IX, F.round(F.coalesce("p", F.lit(1.0)) - F.coalesce("q", F.lit(1.0)), 6).alias("gx"))


REACH = f""", start as (select ix, iy, iz, row_number() over (order by ix, iy, iz) as k from cells), reach(k, ix, iy, iz) as (select k, ix, iy, iz from start union select r.k, s.ix, s.iy, s.iz from reach r, {_FACE}, start s where s.ix = r.ix + a and s.iy = r.iy + b and s.iz = r.iz + c),
 lab as (select ix, iy, iz, min(k) as k from reach group by 1, 2, 3)"""


@query(REACH + " select l.ix, l.iy, l.iz, s.ix as lx, s.iy as ly, s.iz as lz from lab l join start s on s.k = l.k", "cells")
def connected_components(v):
    return components(v.cells).select(*IX, F.col("label.ix").alias("lx"), F.col("label.iy").alias("ly"), F.col("label.iz").alias("lz"))


@query(REACH + ", n as (select k, count(*) as n from lab group by 1) select ix, iy, iz from lab where k = (select arg_max(k, {'n': n, 'k': k}) from n)", "cells")
def largest_component(v):
    return largest(components(v.cells)).select(*IX)


@query(REACH + ", n as (select k, count(*) as n from lab where (ix * 7 + iz) % 5 = 0 group by 1) select ix, iy, iz from lab where k = (select arg_max(k, {'n': n, 'k': k}) from n)", "cells")
def seeded_component(v):
    """The component with most seeds."""
    return seeded(components(v.cells), v.cells.where("(ix * 7 + iz) % 5 = 0")).select(*IX)


@query(f", d1 as (select ix, iy, iz from cells union select ix + a, iy + b, iz + c from cells, {_FACE}), d2 as (select ix, iy, iz from d1 union select ix + a, iy + b, iz + c from d1, {_FACE}) select ix, iy, iz from d2", "cells")
def dilation(v):
    return dilate(v.cells, 2)


@query(f", mask as (select distinct ix, iy, iz from cells union select ix, iy, iz + 1 from cells where n > 1), d1 as (select ix, iy, iz from cells where s % 3 = 0 union select m.ix, m.iy, m.iz from (select ix + a as ix, iy + b as iy, iz + c as iz from cells, {_FACE} where s % 3 = 0) g join mask m using (ix, iy, iz)), d2 as (select ix, iy, iz from d1 union select m.ix, m.iy, m.iz from (select ix + a as ix, iy + b as iy, iz + c as iz from d1, {_FACE}) g join mask m using (ix, iy, iz)) select ix, iy, iz from d2", "cells")
def masked_dilation(v):
    c = v.cells
    mask = c.select(*IX).union(c.where("n > 1").select("ix", "iy", F.col("iz") + 1)).distinct()
    return dilate(c.where("s % 3 = 0"), 2, mask)


FOOT = ", foot as (select distinct ix, 0 as iy, iz from cells)"


def _foot(v):
    return v.cells.select("ix", F.lit(0).alias("iy"), "iz").distinct()


@query(FOOT + f", e as (select ix, iy, iz from (select x.ix + a as ix, x.iy + b as iy, x.iz + c as iz from foot x, {_SQ}) join foot using (ix, iy, iz) group by 1, 2, 3 having count(*) = 4) select ix, iy, iz from e", "cells")
def erosion(v):
    return erode(_foot(v), 1, SQUARE)


def _morph_sql() -> str:
    out, last = FOOT, "foot"
    for i, op in enumerate("eedd" + "dddeee"):
        new = f"m{i}"
        if op == "d":
            out += f", {new} as (select ix, iy, iz from {last} union select x.ix + a, x.iy + b, x.iz + c from {last} x, {_SQ})"
        else:
            out += f", {new} as (select ix, iy, iz from (select x.ix + a as ix, x.iy + b as iy, x.iz + c as iz from {last} x, {_SQ}) join {last} using (ix, iy, iz) group by 1, 2, 3 having count(*) = 4)"
        last = new
    return out + f" select ix, iy, iz from {last}"


@query(_morph_sql(), "cells")
def footprint(v):
    return closed(opened(_foot(v), 2), 3)


@query(FOOT + f""", b as (select min(ix) - 1 a, max(ix) + 1 b, min(iz) - 1 c, max(iz) + 1 d from foot), box as (select cast(x as int) as ix, 0 as iy, cast(z as int) as iz from b, unnest(range(a, b + 1)) as p(x), unnest(range(c, d + 1)) as q(z)),
 empty as (select * from box except select * from foot), outside(ix, iy, iz) as (select a, 0, c from b union select e.ix, e.iy, e.iz from outside o, {_SQ}, empty e where e.ix = o.ix + f.a and e.iz = o.iz + f.c)
 select ix, iy, iz from foot union select ix, iy, iz from (select * from empty except select * from outside)""", "cells")
def filled_footprint(v):
    return fill_holes(_foot(v))


@query(f", near as (select x.ix - a as ix, x.iy - b as iy, x.iz - c as iz, rank, a, b, c from cells x, (values (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1), (3, -1, 0, 0), (4, 0, -1, 0), (5, 0, 0, -1)) as f(rank, a, b, c)), s as (select ix, iy, iz, arg_min(a, rank) as nx, arg_min(b, rank) as ny, arg_min(c, rank) as nz from near where not exists (select 1 from cells k where k.ix = near.ix and k.iy = near.iy and k.iz = near.iz) group by 1, 2, 3) select *, case when ny > 0.7 then 'floor' when ny < -0.7 then 'ceiling' else 'wall' end as kind from s", "cells")
def room_shell(v):
    return shell(v.cells)


@query(", h as (select ix, iz, max(iy) as h from cells group by 1, 2), a as (select ix, iz, max(h) over (partition by iz order by ix range between 2 preceding and 2 following) as h from h), b as (select ix, iz, max(h) over (partition by ix order by iz range between 2 preceding and 2 following) as h from a), c as (select ix, iz, min(h) over (partition by iz order by ix range between 2 preceding and 2 following) as h from b) select ix, iz, min(h) over (partition by ix order by iz range between 2 preceding and 2 following) as h from c", "cells")
def ceiling_closing(v):
    return grey_closing(v.cells.groupBy("ix", "iz").agg(F.max("iy").alias("h")), "h", "ix", "iz", 2)


@query(", h as (select ix, iz, max(iy) as h from cells group by 1, 2), known as (select * from h where (ix + iz) % 4 = 0), d as (select a.ix, a.iz, arg_min(k.h, {'d': (a.ix - k.ix) ** 2 + (a.iz - k.iz) ** 2, 'x': k.ix, 'z': k.iz}) as h from h a, known k group by 1, 2) select * from d", "cells")
def nearest_extension(v):
    from voxelith.operators.neighbors import nearest

    h = v.cells.groupBy("ix", "iz").agg(F.max("iy").alias("h")).withColumns({"k": F.col("ix") * 1000 + F.col("iz"), "zero": F.lit(0)})
    near = nearest(h, h.where("(ix + iz) % 4 = 0"), 1, 4, "k", ("ix", "iz", "zero"), ("h",))
    return near.select(F.floor(F.col("a") / 1000).cast("int").alias("ix"), (F.col("a") % 1000).alias("iz"), "h")


@query(" select ix, iz, count(*) as n, max(iy) as top, cast(sum(n) as bigint) as points from cells group by 1, 2", "cells")
def column_summary(v):
    return v.cells.groupBy("ix", "iz").agg(F.count("*").alias("n"), F.max("iy").alias("top"), F.sum("n").alias("points"))


ROOM_CELLS, CELL, FAR = (24, 8, 24), 0.5, 6.0
_FUSED = """, cells as materialized (select cast(i as int) as ix, cast(j as int) as iy, cast(k as int) as iz, (i + 0.5e0) * 0.5e0 as px, (j + 0.5e0) * 0.5e0 as py, (k + 0.5e0) * 0.5e0 as pz
   from unnest(range(0, 24 * (select max(room) + 1 from poses))) as a(i), unnest(range(0, 8)) as b(j), unnest(range(0, 24)) as c(k)),
 cam as (select ix, iy, iz, frame, r00 * px + r01 * py + r02 * pz + tx as x, r10 * px + r11 * py + r12 * pz + ty as y, r20 * px + r21 * py + r22 * pz + tz as z from cells, poses),
 seen as (select ix, iy, iz, frame, z, cast(round_even(8e0 * x / z + 8e0, 0) as int) as u, cast(round_even(8e0 * y / z + 6e0, 0) as int) as v from cam where z > 1e-6 and z <= 6),
 samples as (select ix, iy, iz, depth - z as sdf, greatest(0.03e0 * z, 1.5e0) as t, red, green, blue from seen join depth_maps using (frame, u, v) where depth > 0),
 fused as materialized (select ix, iy, iz, coalesce(round(avg(least(sdf / t, 1e0)) filter (sdf > -t), 12), 1e0) as tsdf, count(*) filter (sdf > -t) as weight, count(*) filter (abs(sdf) < t) as near,
   coalesce(sum(red) filter (abs(sdf) < t), 0) / greatest(count(*) filter (abs(sdf) < t), 1) as red, coalesce(sum(green) filter (abs(sdf) < t), 0) / greatest(count(*) filter (abs(sdf) < t), 1) as green,
   coalesce(sum(blue) filter (abs(sdf) < t), 0) / greatest(count(*) filter (abs(sdf) < t), 1) as blue, count(*) filter (sdf > t) as free, count(*) filter (sdf < -t) as occluded from samples group by 1, 2, 3)"""


def _fused(v):
    """The rooms' grid and their volume, over every frame and cell."""
    from voxelith.operators.fusion import Grid, fuse_frames

    rooms = (v.poses.agg(F.max("room")).first()[0] or 0) + 1
    grid = Grid((0.0, 0.0, 0.0), CELL, (ROOM_CELLS[0] * rooms, *ROOM_CELLS[1:]))
    return grid, fuse_frames(v.poses, v.depth_maps, grid, FAR)


@query(_FUSED + " select ix, iy, iz, cast(round(1e6 * tsdf) as bigint) as tsdf, weight, near, cast(round(1e6 * red) as bigint) as red, cast(round(1e6 * green) as bigint) as green, cast(round(1e6 * blue) as bigint) as blue, free, occluded from fused", "poses", "depth_maps")
def fused_volume(v):
    """Fusion of all frames by the tiles they see; the SQL tries all pairs of cells and frames."""
    return _fused(v)[1].withColumns({c: F.round(1e6 * F.col(c)).cast("bigint") for c in ("tsdf", "red", "green", "blue")})


_STEPS = {"ix": "a.ix + 1 = b.ix and a.iy = b.iy and a.iz = b.iz", "iy": "a.ix = b.ix and a.iy + 1 = b.iy and a.iz = b.iz", "iz": "a.ix = b.ix and a.iy = b.iy and a.iz + 1 = b.iz"}


def _gradient_sql(axis: str, most: str) -> str:
    of = lambda sign: f"coalesce((select tsdf from fused n where {' and '.join(f'n.{i} = f.{i}' + (f' {sign} 1' if i == axis else '') for i in _STEPS)}), 1e0)"
    return f"case when {axis} = 0 then {of('+')} - tsdf when {axis} = {most} then tsdf - {of('-')} else ({of('+')} - {of('-')}) / 2 end as g{axis[1]}"


_SURFACE = _FUSED + f""", wide as (select *, 24 * (select max(room) + 1 from poses) - 1 as last from fused),
 g as materialized (select f.*, {', '.join(_gradient_sql(a, m) for a, m in (('ix', 'last'), ('iy', '7'), ('iz', '23')))} from wide f),
 met as ({' union all '.join(f"select {k} as axis, a.ix, a.iy, a.iz, a.tsdf / (a.tsdf - b.tsdf) as f, a.near > 0 as na, b.near > 0 as nb, a.green as ga, b.green as gb, a.gx + b.gx as x, a.gy + b.gy as y, a.gz + b.gz as z from g a join g b on {on} where a.weight >= 3 and b.weight >= 3 and (a.tsdf > 0) <> (b.tsdf > 0) and abs(a.tsdf - b.tsdf) <= 1 and (a.near > 0 or b.near > 0)" for k, on in enumerate(_STEPS.values()))}),
 mixed as (select *, case when na then 1 - f else 0 end as wa, case when nb then f else 0 end as wb, greatest(sqrt(x * x + y * y + z * z), 1e-9) as len from met)
 select axis, ix, iy, iz, cast(round(1e6 * (ix + 0.5 + case when axis = 0 then f else 0 end) / 2) as bigint) as x, cast(round(1e6 * (iy + 0.5 + case when axis = 1 then f else 0 end) / 2) as bigint) as y,
        cast(round(1e6 * (iz + 0.5 + case when axis = 2 then f else 0 end) / 2) as bigint) as z, cast(round(1e5 * (ga * wa + gb * wb) / greatest(wa + wb, 1e-9)) as bigint) as green,
        cast(round(1e6 * x / len) as bigint) as nx, cast(round(1e6 * y / len) as bigint) as ny, cast(round(1e6 * z / len) as bigint) as nz from mixed"""


@query(_SURFACE, "poses", "depth_maps")
def fused_surface(v):
    """Surface points of the fused volume with place, colour and normal."""
    from voxelith.operators.fusion import surface

    grid, volume = _fused(v)
    s = surface(volume, grid)
    fixed = {c: F.round(1e6 * F.col(c)).cast("bigint") for c in ("x", "y", "z", "nx", "ny", "nz")} | {"green": F.round(1e5 * F.col("green")).cast("bigint")}
    return s.withColumns(fixed).drop("red", "blue")


@query(""", cam as (select frame, r00 * p.x + r01 * p.y + r02 * p.z + tx as x, r10 * p.x + r11 * p.y + r12 * p.z + ty as y, r20 * p.x + r21 * p.y + r22 * p.z + tz as z from points p, poses),
 low as (select frame, cast(floor((8e0 * y / z + 6e0) / 4) as int) as v, cast(floor((8e0 * x / z + 8e0) / 4) as int) as u, z from cam where z > 1e-6 and z <= 6)
 select frame, v, u, cast(round(1e6 * min(z)) as bigint) as rendered from low where v between 0 and 2 and u between 0 and 3 group by 1, 2, 3""", "points", "poses")
def rendered_depths(v):
    """The nearest point in each coarse pixel of every frame; the SQL tries all pairs of points and frames."""
    from voxelith.operators.fusion import Grid
    from voxelith.operators.refine import render

    edge = Grid((-12.0, -12.0, -12.0), CELL, (96, 96, 96))  # the points' own box, 0 to 20, 10 and 5
    return render(v.points, v.poses, edge, FAR).withColumn("rendered", F.round(1e6 * F.col("rendered")).cast("bigint"))


@query(None)
def refined_depths(v):
    """Depths after a round of fusion, rendering and refitting; tests hold the steps against dense arithmetic."""
    from voxelith.operators.fusion import Grid
    from voxelith.operators.refine import refined

    rooms = (v.poses.agg(F.max("room")).first()[0] or 0) + 1
    grid = Grid((0.0, 0.0, 0.0), CELL, (ROOM_CELLS[0] * rooms, *ROOM_CELLS[1:]))
    return refined(v.poses, v.depth_maps.select("frame", "v", "u", "depth"), grid, FAR, rounds=1, factor=2, least=4)[0]
