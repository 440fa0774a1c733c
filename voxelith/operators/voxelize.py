"""From points to coloured cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.aggregates import lower_median, weighted_median
from voxelith.functions.color import with_lab
from voxelith.functions.geometry import Matrix, check_rigid, finite, rigid, rotate
from voxelith.functions.grid import FACES, cell, in_grid, offsets

IX = ("ix", "iy", "iz")


def crop_to_grid(points: DataFrame, lower: Sequence[float], upper: Sequence[float], size: float, transform: Matrix | None = None) -> tuple[DataFrame, tuple[int, int, int]]:
    """Transformed finite points inside the inclusive crop, with their cells; and the grid's dimensions.

    Without a transform the crop is a plain predicate on the columns, so it reaches the scan."""
    df = points.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    if transform is not None:
        check_rigid(transform)
        x, y, z = rigid(F.col("x"), F.col("y"), F.col("z"), transform)
        df = df.withColumns({"x": x, "y": y, "z": z})
        if {"nx", "ny", "nz"} <= set(points.columns):
            a, b, c = rotate(F.col("nx"), F.col("ny"), F.col("nz"), transform)
            df = df.withColumns({"nx": a, "ny": b, "nz": c})
    for n, lo, hi in zip("xyz", lower, upper, strict=True):
        df = df.where(F.col(n).between(lo, hi))
    dims = tuple(max(1, -int(-((hi - lo) / size - 1e-12) // 1)) for lo, hi in zip(lower, upper, strict=True))
    return df.withColumns({i: cell(F.col(n), lo, size, d) for i, n, lo, d in zip(IX, "xyz", lower, dims, strict=True)}), dims


def accept_cells(points: DataFrame, lower: Sequence[float], size: float, *, min_points: int = 2, min_views: int = 1, min_confidence: float = 0.0, max_nearest: float | None = None, free: DataFrame | None = None, dims: tuple[int, int, int] | None = None) -> DataFrame:
    """(ix, iy, iz, n, views, confidence, nearest, med_r, med_g, med_b) of the cells that pass.

    free: cells known to be empty (those outside the grid do not count).  Views count distinct view_id, or the greatest
    support where there is such a column; without either the threshold does not apply.  Colours are lower medians.
    All are aggregates that combine where the points are; a cell's states grow with its distinct colours and views only."""
    if free is not None:
        gone = free.select(*IX).distinct()
        points = points.join(gone.where(in_grid(dims)) if dims else gone, list(IX), "left_anti")
    centre = F.lit(0.0)
    for i, n, lo in zip(IX, "xyz", lower, strict=True):
        d = F.col(n) - (F.lit(float(lo)) + (F.col(i) + 0.5) * F.lit(size))
        centre = centre + d * d
    views = F.max("support") if "support" in points.columns else F.size(F.collect_set("view_id")) if "view_id" in points.columns else F.lit(None)
    conf = F.avg(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))) if "confidence" in points.columns else F.lit(1.0)
    out = points.groupBy(*IX).agg(
        F.count("*").alias("n"), views.cast("bigint").alias("views"), conf.alias("confidence"), F.min(F.sqrt(centre)).alias("nearest"),
        *(lower_median(c).alias(f"med_{c[0]}") for c in ("red", "green", "blue")),
    )
    keep = (F.col("n") >= min_points) & (F.col("confidence") >= min_confidence)
    if "support" in points.columns or "view_id" in points.columns:
        keep = keep & (F.col("views") >= min_views)
    if max_nearest is not None:
        keep = keep & (F.col("nearest") <= max_nearest * size)
    return out.where(keep)


def weighted_cells(points: DataFrame, value: str, weight: str, ties: list[str]) -> DataFrame:
    return weighted_median(points, list(IX), value, weight, ties, f"wmed_{value}")


def drop_isolated(cells: DataFrame, strong: int | None = None) -> DataFrame:
    """Cells with a face neighbour; those of at least ``strong`` points stay without one."""
    near = offsets(cells.select(*IX), IX, FACES).distinct()
    kept = cells.join(near, list(IX), "left_semi")
    return kept if strong is None else kept.unionByName(cells.where(F.col("n") >= strong).join(near, list(IX), "left_anti"))


#: Entries of a palette at most: what is sent to every task has a proven bound.
LARGEST_PALETTE = 65_535


def match_palette(cells: DataFrame, palette: DataFrame, rgb: tuple[str, str, str] = ("med_r", "med_g", "med_b"), digits: int = 9) -> DataFrame:
    """cells (distinct ix, iy, iz) with palette_id and block_state of the least Lab distance plus penalty; ties go to the palette's first.

    The palette is a dimension: one row holds it as an array, and more than LARGEST_PALETTE entries are an error.  Each cell
    meets the entries in generated code and keeps the least of score and place in one number, within its partition, as cells
    are grouped by their place already.  Cells without a colour are left out."""
    own, lab = ("_lab_l", "_lab_a", "_lab_b"), ("l", "a", "b")
    entries = with_lab(palette, ("pr", "pg", "pb"), lab)
    whole = entries.agg(F.sort_array(F.collect_list(F.struct("pos", *lab, "penalty"))).alias("_palette"))
    whole = whole.where(F.coalesce(F.assert_true(F.size("_palette") <= LARGEST_PALETTE, f"more than {LARGEST_PALETTE} palette entries").cast("boolean"), F.lit(True)))
    coloured = with_lab(cells.where(F.col(rgb[0]).isNotNull() & F.col(rgb[1]).isNotNull() & F.col(rgb[2]).isNotNull()), rgb, own)
    tried = coloured.crossJoin(F.broadcast(whole)).select(*cells.columns, *own, F.posexplode("_palette").alias("_at", "_e"))  # one row on the right
    d = sum(((F.col(o) - F.col(f"_e.{n}")) * (F.col(o) - F.col(f"_e.{n}")) for o, n in zip(own, lab, strict=True)), F.lit(0.0))
    score = F.rint(F.round(F.sqrt(d) + F.col("_e.penalty"), digits) * 10**digits).cast("bigint") * (LARGEST_PALETTE + 1) + F.col("_at")
    rest = [c for c in cells.columns if c not in IX]
    best = tried.groupBy(*IX).agg(F.min(score).alias("_best"), *(F.first(c).alias(c) for c in rest))
    order = entries.agg(F.sort_array(F.collect_list(F.struct("pos", "palette_id", "block_state"))).alias("_names"))
    named = best.crossJoin(F.broadcast(order)).withColumn("_m", F.get("_names", (F.col("_best") % (LARGEST_PALETTE + 1)).cast("int")))
    return named.select(*cells.columns, "_m.palette_id", "_m.block_state")


def ray_cells(rays: DataFrame, size: float, key: str = "ray") -> DataFrame:
    """Cells that a ray from (ox, oy, oz) to (x, y, z) crosses, sampled twice a cell, without its end's cell."""
    length = F.greatest(F.abs(F.col("x") - F.col("ox")), F.abs(F.col("y") - F.col("oy")), F.abs(F.col("z") - F.col("oz")))
    steps = F.greatest(F.lit(1), F.ceil(2 * length / size)).cast("int")
    df = rays.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("_i") / F.col("_n")
    at = {i: F.floor((F.col(f"o{n}") + (F.col(n) - F.col(f"o{n}")) * t) / size).cast("int") for i, n in zip(IX, "xyz", strict=True)}
    end = {f"_e{n}": F.floor(F.col(n) / size).cast("int") for n in "xyz"}
    df = df.withColumns(at).withColumns(end)
    return df.where((F.col("ix") != F.col("_ex")) | (F.col("iy") != F.col("_ey")) | (F.col("iz") != F.col("_ez"))).select(key, *IX).distinct()


def carved_cells(rays: DataFrame, size: float, observed: DataFrame, dims: tuple[int, int, int], key: str = "ray") -> DataFrame:
    """(ix, iy, iz) that some ray crosses, of the grid, without cells that are themselves observed: a ray that grazes a
    surface does not carve it."""
    free = ray_cells(rays, size, key).select(*IX).where(in_grid(dims)).distinct()
    return free.join(observed.select(*IX).distinct(), list(IX), "left_anti")


def splat(points: DataFrame, lower: Sequence[float], size: float, radius: float, key: str) -> DataFrame:
    """(key, cell): a point's own cell and the neighbours whose centres are at most radius cells from it."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    df = offsets(points.select(key, "x", "y", "z", *(F.col(i).alias(f"_{i}") for i in IX)), ("_ix", "_iy", "_iz"), steps, IX)
    d = F.lit(0.0)
    for i, n, lo in zip(IX, "xyz", lower, strict=True):
        e = (F.col(n) - F.lit(float(lo))) / F.lit(size) - (F.col(i) + 0.5)
        d = d + e * e
    own = (F.col("ix") == F.col("_ix")) & (F.col("iy") == F.col("_iy")) & (F.col("iz") == F.col("_iz"))
    return df.where(own | (d <= radius * radius)).select(key, *IX).distinct()
