"""Volumes fused from depth frames, and the surfaces in them.

Frames and cells meet through an index of tiles: each frame lists the tiles its view pyramid may touch, tiles list their
cells, and the cells that project into the frame meet its depth by an equi-join on (frame, v, u).  Nothing is joined with
all frames or all cells; sums are additive, so a cell that any number of frames see is aggregated in parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.geometry import project
from voxelith.operators.lineage import apart, cut
from voxelith.operators.volume import IX

#: Cells of a tile's edge.
TILE = 8
#: Truncation: this share of the depth, and this many cells at least.
RELATIVE, LEAST_CELLS = 0.03, 3.0
#: A surface needs this many views on both of its sides.
LEAST_WEIGHT = 3
ROTATION = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
POSE = (*ROTATION, "tx", "ty", "tz", "fx", "fy", "cx", "cy", "width", "height")


@dataclass(frozen=True)
class Grid:
    """Cells 0 to shape - 1 of one size from an origin."""

    origin: tuple[float, float, float]
    size: float
    shape: tuple[int, int, int]

    def centre(self, axis: int, i: Column) -> Column:
        return F.lit(float(self.origin[axis])) + (i + 0.5) * F.lit(float(self.size))


def to_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A world point in the frame's camera: rotation (r00 to r22) and translation (tx, ty, tz) of the row."""
    return tuple(F.col(f"r{i}0") * x + F.col(f"r{i}1") * y + F.col(f"r{i}2") * z + F.col(t) for i, t in enumerate(("tx", "ty", "tz")))


def over_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """df over all tasks: frames lie in few files, but each stands for many tiles, and a tile for hundreds of cells."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def frame_tiles(frames: DataFrame, grid: Grid, far: Column | float, pad: float = 0.0) -> DataFrame:
    """frames with every tile (_t0, _t1, _t2) that their view pyramid up to depth ``far`` may touch: those in the box around
    it whose bounding sphere is not wholly beyond one of its sides.  The picture counts as wider by ``pad`` pixels on every side."""
    far = F.lit(far) if not isinstance(far, Column) else far
    f = cut(frames.select("frame", *POSE, far.alias("_far")))  # rows of frames; cut, as each column is used many times below and would be spelled out in full there
    # the eye and the far corners: along each axis, a corner is the eye plus far times (r0 * across + r1 * down + r2)
    f = f.withColumns({f"_{k}{i}": (bound - F.col(c)) / F.col(f_) for k, c, f_, size in (("u", "cx", "fx", "width"), ("v", "cy", "fy", "height")) for i, bound in enumerate((F.lit(-0.5 - pad), F.col(size) - 0.5 + pad))})
    f = f.withColumns({f"_e{j}": -(F.col(f"r0{j}") * F.col("tx") + F.col(f"r1{j}") * F.col("ty") + F.col(f"r2{j}") * F.col("tz")) for j in range(3)})
    edge = TILE * grid.size
    low, high = [], []
    for j in range(3):
        across, down = ([F.col(f"r{i}{j}") * F.col(f"_{k}{s}") for s in (0, 1)] for i, k in enumerate("uv"))
        for out, f_, g in ((low, F.least, F.greatest), (high, F.greatest, F.least)):
            end = f_(F.lit(0.0), F.col("_far") * (f_(*across) + f_(*down) + F.col(f"r2{j}")))
            most = F.lit(0 if out is low else (grid.shape[j] - 1) // TILE)
            out.append(g(F.floor((F.col(f"_e{j}") + end - grid.origin[j]) / edge), most).cast("int"))
    f = cut(f.withColumns({f"_a{a}": low[a] for a in range(3)} | {f"_b{a}": high[a] for a in range(3)}).drop(*(f"_{k}{i}" for k in "uv" for i in (0, 1)), *(f"_e{j}" for j in range(3))))
    f = over_tasks(f, "frame")
    for a in range(3):
        f = f.where(F.col(f"_a{a}") <= F.col(f"_b{a}")).withColumn(f"_t{a}", F.explode(F.sequence(f"_a{a}", f"_b{a}")))
    middle = [F.lit(float(grid.origin[a])) + (F.col(f"_t{a}") + 0.5) * edge for a in range(3)]
    x, y, z = to_camera(*middle)
    f = f.withColumns({"_x": x, "_y": y, "_z": z}).drop(*(f"_{k}{a}" for k in "ab" for a in range(3)))
    reach = edge * 3**0.5 / 2 * 1.0001
    inside = (F.col("_z") > -reach) & (F.col("_z") < F.col("_far") + reach)
    for at, focal, middle_, most in (("_x", "fx", "cx", "width"), ("_y", "fy", "cy", "height")):
        for bound, side in ((F.lit(-0.5 - pad), 1), (F.col(most) - 0.5 + pad, -1)):  # image planes through the eye: focal * at - (bound - middle) * z = 0
            slope = bound - F.col(middle_)
            away = side * (F.col(focal) * F.col(at) - slope * F.col("_z")) / F.sqrt(F.col(focal) * F.col(focal) + slope * slope)
            inside = inside & (away > -reach)
    return f.where(inside).drop("_x", "_y", "_z")


def cell_samples(frames: DataFrame, depths: DataFrame, grid: Grid, far: Column | float, colours: tuple[str, ...] = ()) -> DataFrame:
    """(ix, iy, iz, frame, sdf, trunc, colours): of each cell and each frame that has a depth where the cell's centre projects."""
    tiles = over_tasks(frame_tiles(frames, grid, far), "frame", "_t0", "_t1", "_t2")
    # axis by axis, so that what a row of cells shares is worked out once and no expression holds all three
    cells = tiles
    for a, n in enumerate(IX):
        last = F.least(F.col(f"_t{a}") * TILE + (TILE - 1), F.lit(grid.shape[a] - 1))
        cells = cells.withColumn(n, F.explode(F.sequence(F.col(f"_t{a}") * TILE, last))).drop(f"_t{a}")
        part = tuple((F.col(p) if a else F.lit(0.0)) + F.col(f"r{i}{a}") * grid.centre(a, F.col(n)) for i, p in enumerate(("_x", "_y", "_z")))
        cells = cells.withColumns(dict(zip(("_x", "_y", "_z"), part, strict=True))).drop(*(f"r{i}{a}" for i in range(3)))
    cells = cells.withColumns({p: F.col(p) + F.col(t) for p, t in (("_x", "tx"), ("_y", "ty"), ("_z", "tz"))}).where((F.col("_z") > 1e-6) & (F.col("_z") <= F.col("_far")))
    u, v = project(F.col("_x"), F.col("_y"), F.col("_z"), *(F.col(c) for c in ("fx", "fy", "cx", "cy")))
    cells = cells.select("frame", *IX, "_z", F.rint(u).cast("int").alias("u"), F.rint(v).cast("int").alias("v"), "width", "height")
    cells = cells.where(F.col("u").between(F.lit(0), F.col("width") - 1) & F.col("v").between(F.lit(0), F.col("height") - 1)).drop("width", "height")
    # cells count as few as the tiles they come from; of the two sides, neither fits the driver
    seen = apart(cells).join(depths.where("depth > 0").select("frame", "v", "u", "depth", *colours), ["frame", "v", "u"])
    trunc = F.greatest(F.lit(RELATIVE) * F.col("_z"), F.lit(LEAST_CELLS * grid.size))
    return seen.select(*IX, "frame", (F.col("depth") - F.col("_z")).alias("sdf"), trunc.alias("trunc"), *colours)


def fuse_frames(frames: DataFrame, depths: DataFrame, grid: Grid, far: Column | float, colours: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Per cell that some frame sees: tsdf (mean of least(sdf / trunc, 1) over samples above -trunc, to 12 places, so that the
    order of a sum does not decide its sign; 1 if there is none), weight (their count),
    near (those within the band) with the mean of their colours (0 without any), and votes for free and occluded.

    frames: frame, r00 to r22, tx, ty, tz, fx, fy, cx, cy, width, height.  depths: frame, v, u, depth (0 or null: none), colours."""
    s = cell_samples(frames, depths, grid, far, colours)
    sdf, t = F.col("sdf"), F.col("trunc")
    over = sdf > -t
    near = over & (sdf < t)
    sums = [F.coalesce(F.sum(F.when(near, F.col(c))), F.lit(0)).alias(c) for c in colours]
    out = s.groupBy(*IX).agg(
        F.coalesce(F.round(F.avg(F.when(over, F.least(sdf / t, F.lit(1.0)))), 12), F.lit(1.0)).alias("tsdf"), F.count_if(over).alias("weight"), F.count_if(near).alias("near"),
        *sums, F.count_if(sdf > t).alias("free"), F.count_if(sdf < -t).alias("occluded"),
    )
    return out.withColumns({c: F.col(c) / F.greatest(F.col("near"), F.lit(1)) for c in colours})


def gradients(volume: DataFrame, grid: Grid, value: str = "tsdf", absent: float = 1.0) -> DataFrame:
    """volume with gx, gy, gz: half the difference of the neighbours' values (absent cells of the grid count as ``absent``),
    at the grid's faces the difference to the one neighbour.  All six neighbours come in one exchange."""
    names = [c for c in volume.columns if c not in IX]
    steps = [(0, 0, 0)] + [tuple(s if k == a else 0 for k in range(3)) for a in range(3) for s in (-1, 1)]
    moved = volume.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(f"d{a}") for a, v in enumerate(s))) for i, s in enumerate(steps)))))
    moved = moved.select(*((F.col(n) + F.col(f"_s.d{a}")).alias(n) for a, n in enumerate(IX)), F.col("_s.i").alias("_i"), F.col(value).alias("_v"), F.when(F.col("_s.i") == 0, F.struct(*names)).alias("_own"))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_{i}")
    met = moved.groupBy(*IX).agg(F.max("_own").alias("_own"), *(at(i) for i in range(1, 7))).where("_own is not null")
    out = met.select(*IX, "_own.*", *(f"_{i}" for i in range(1, 7)))
    grads = {}
    for a, (n, g) in enumerate(zip(IX, ("gx", "gy", "gz"), strict=True)):
        # the neighbour that stepped up by one is the lower one
        lower, upper = F.coalesce(F.col(f"_{2 * a + 2}"), F.lit(absent)), F.coalesce(F.col(f"_{2 * a + 1}"), F.lit(absent))
        first, last = F.col(n) == 0, F.col(n) == grid.shape[a] - 1
        grads[g] = F.when(first & last, F.lit(0.0)).when(first, upper - F.col(value)).when(last, F.col(value) - lower).otherwise((upper - lower) / 2)
    return out.withColumns(grads).drop(*(f"_{i}" for i in range(1, 7)))


def surface(volume: DataFrame, grid: Grid, least: int = LEAST_WEIGHT, colours: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """(axis, ix, iy, iz, x, y, z, colours, nx, ny, nz): where the distance changes sign between a cell and its upper
    neighbour on an axis, both seen by ``least`` views, one of them near the surface, and at most 1 apart.

    The position is by linear zero crossing; colours are blended by it from the cells that have some; the normal is the sum of both
    gradients.  Cells meet their three upper neighbours in one exchange."""
    kept = ["tsdf", "near", "gx", "gy", "gz", *colours]
    v = gradients(volume, grid).where(F.col("weight") >= least).select(*IX, F.struct(*kept).alias("_c"))
    steps = [(0, 0, 0), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    moved = v.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(d).alias(f"d{a}") for a, d in enumerate(s))) for i, s in enumerate(steps)))))
    moved = moved.select(*((F.col(n) + F.col(f"_s.d{a}")).alias(n) for a, n in enumerate(IX)), F.col("_s.i").alias("_i"), "_c")
    met = moved.groupBy(*IX).agg(*(F.max(F.when(F.col("_i") == i, F.col("_c"))).alias(k) for i, k in enumerate(("a", "b0", "b1", "b2")))).where("a is not null")
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(f"b{i}").alias("b")) for i in range(3))))
    pair = met.withColumn("_p", sides).select(*IX, "a", F.col("_p.axis").alias("axis"), F.col("_p.b").alias("b")).where("b is not null")
    a, b = F.col("a.tsdf"), F.col("b.tsdf")
    pair = pair.where(((a > 0) != (b > 0)) & (F.abs(a - b) <= 1) & ((F.col("a.near") > 0) | (F.col("b.near") > 0))).withColumn("_f", a / (a - b))
    place = [grid.centre(k, F.col(n) + F.when(F.col("axis") == k, F.col("_f")).otherwise(F.lit(0.0))) for k, n in enumerate(IX)]
    wa, wb = F.when(F.col("a.near") > 0, 1 - F.col("_f")).otherwise(F.lit(0.0)), F.when(F.col("b.near") > 0, F.col("_f")).otherwise(F.lit(0.0))
    mixed = [((F.col(f"a.{c}") * wa + F.col(f"b.{c}") * wb) / F.greatest(wa + wb, F.lit(1e-9))).alias(c) for c in colours]
    normal = [F.col(f"a.{g}") + F.col(f"b.{g}") for g in ("gx", "gy", "gz")]
    length = F.greatest(F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2]), F.lit(1e-9))
    return pair.select("axis", *IX, *(p.alias(n) for p, n in zip(place, "xyz", strict=True)), *mixed, *((c / length).alias(n) for c, n in zip(normal, ("nx", "ny", "nz"), strict=True)))
