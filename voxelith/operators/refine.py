"""Depth refinement: the fused surface is rendered into every frame, and each frame's depth is refitted to it.

A refit is affine in inverse depth (robust least squares) and a smooth correction of what is left, block means blurred and
upsampled; a frame keeps it only if its median error against the rendered surface falls.  Points meet frames by tiles,
pixels meet blocks by one equi-join with quads of neighbouring blocks; per-frame figures are aggregates by frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.aggregates import robust_affine
from voxelith.functions.geometry import project
from voxelith.operators.fusion import TILE, Grid, frame_tiles, fuse_frames, surface, to_camera
from voxelith.operators.lineage import apart, cut

#: Fixed values of the refit: pixels a frame needs, share of depth beyond which a pixel is an outlier, block edge, passes of the blur and its weights.
LEAST_PIXELS, OUTLIER, BLOCK, PASSES, TAPS = 400, 0.15, 8, 12, (1.0, 4.0, 6.0, 4.0, 1.0)
FACTOR, ROUNDS = 4, 2


def render(points: DataFrame, frames: DataFrame, grid: Grid, far: Column | float, factor: int = FACTOR) -> DataFrame:
    """(frame, v, u, rendered): the nearest point of each pixel of 1/factor of a frame's size.  Points beyond the grid are not seen."""
    edge = TILE * grid.size
    at = {f"_t{a}": F.floor((F.col(n) - grid.origin[a]) / edge).cast("int") for a, n in enumerate("xyz")}
    keyed = points.select("x", "y", "z").withColumns(at)
    met = apart(frame_tiles(frames, grid, far, float(factor))).join(keyed, list(at))
    x, y, z = to_camera(F.col("x"), F.col("y"), F.col("z"))
    met = met.withColumns({"_cx": x, "_cy": y, "_cz": z}).where((F.col("_cz") > 1e-6) & (F.col("_cz") <= F.col("_far")))
    u, v = project(F.col("_cx"), F.col("_cy"), F.col("_cz"), *(F.col(c) for c in ("fx", "fy", "cx", "cy")))
    seen = met.select("frame", F.floor(v / factor).cast("int").alias("v"), F.floor(u / factor).cast("int").alias("u"), F.col("_cz").alias("z"), F.ceil(F.col("height") / factor).alias("_h"), F.ceil(F.col("width") / factor).alias("_w"))
    seen = seen.where((F.col("v") >= 0) & (F.col("u") >= 0) & (F.col("v") < F.col("_h")) & (F.col("u") < F.col("_w")))
    return seen.groupBy("frame", "v", "u").agg(F.min("z").alias("rendered"))


def blurred(sums: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Rows and columns by the taps, zeros beyond the edges, again and again: two fixed matrices, one to a side."""

    def matrix(n: int) -> np.ndarray:
        once = sum(np.diag(np.full(n - abs(k), t), k) for k, t in zip(range(-2, 3), TAPS, strict=True) if n > abs(k))
        return np.linalg.matrix_power(once / sum(TAPS), passes)

    return matrix(sums.shape[0]) @ sums @ matrix(sums.shape[1])


def block_means(values: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """(frame, r, c, value, rows, cols): smooth block means of values (frame, v, u, value, height, width), for every block of a frame.

    Sums and counts are blurred alike, so their quotient reaches into blocks without values; those out of reach have 0."""
    at = [F.floor(F.col(n) / block).cast("int").alias(k) for n, k in (("v", "r"), ("u", "c"))]
    sides = [F.max(F.ceil(F.col(n) / block)).cast("int").alias(k) for n, k in (("height", "rows"), ("width", "cols"))]
    sums = values.groupBy("frame", *at).agg(F.sum("value").alias("s"), F.count("value").cast("double").alias("n"), *sides)
    kind = sums.schema["frame"].dataType.simpleString()

    def spread(rows: pa.Table) -> pa.Table:  # one frame's blocks
        shape = rows["rows"][0].as_py(), rows["cols"][0].as_py()
        s, n = np.zeros(shape), np.zeros(shape)
        where = rows["r"].to_numpy(), rows["c"].to_numpy()
        s[where], n[where] = rows["s"].to_numpy(), rows["n"].to_numpy()
        s, n = blurred(s, passes), blurred(n, passes)
        r, c = (i.ravel().astype(np.int32) for i in np.indices(shape))
        value = np.where(n > 1e-12, s / np.maximum(n, 1e-12), 0.0).ravel()
        frame = pa.chunked_array([pa.repeat(rows["frame"][0], len(r))])
        return pa.table({"frame": frame, "r": r, "c": c, "value": value, "rows": np.full(len(r), shape[0], np.int32), "cols": np.full(len(r), shape[1], np.int32)})

    return sums.groupBy("frame").applyInArrow(spread, f"frame {kind}, r int, c int, value double, rows int, cols int")


def upsampled(targets: DataFrame, field: DataFrame, as_: str = "correction") -> DataFrame:
    """targets (frame, v, u, height, width) with the field (frame, r, c, value, rows, cols) between the four nearest of its
    places, centres on centres, edges repeated; frames without a field get 0.  A target meets one row, a place's quad."""
    roles = [(0, 0), (0, 1), (1, 0), (1, 1)]
    moved = field.withColumn("_q", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in roles))))
    moved = moved.select("frame", "rows", "cols", (F.col("r") - F.col("_q.a")).alias("_r"), (F.col("c") - F.col("_q.b")).alias("_c"), (2 * F.col("_q.a") + F.col("_q.b")).alias("_k"), "value")
    quads = moved.where("_r >= 0 and _c >= 0").groupBy("frame", "_r", "_c").agg(*(F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"_f{k}") for k in range(4)))
    quads = quads.withColumns({"_f1": F.coalesce("_f1", "_f0"), "_f2": F.coalesce("_f2", "_f0")}).withColumn("_f3", F.coalesce("_f3", F.when(F.col("_f2") != F.col("_f0"), F.col("_f2")).otherwise(F.col("_f1"))))
    sides = field.groupBy("frame").agg(F.max("rows").alias("_rows"), F.max("cols").alias("_cols"))
    t = targets.join(sides, "frame", "left")
    for n, size, count, place, weight in (("v", "height", "_rows", "_r", "_wr"), ("u", "width", "_cols", "_c", "_wc")):
        source = (F.col(n) + 0.5) * F.col(count) / F.col(size) - 0.5
        t = t.withColumn("_s", source).withColumns({place: F.greatest(F.floor("_s"), F.lit(0)).cast("int"), weight: F.greatest(F.col("_s"), F.lit(0.0)) - F.greatest(F.floor("_s"), F.lit(0))}).drop("_s")
    t = t.join(quads, ["frame", "_r", "_c"], "left")
    upper, lower = (F.col(f"_f{k}") * (1 - F.col("_wc")) + F.col(f"_f{k + 1}") * F.col("_wc") for k in (0, 2))
    value = F.coalesce(upper * (1 - F.col("_wr")) + lower * F.col("_wr"), F.lit(0.0))
    return t.withColumn(as_, value).drop("_rows", "_cols", "_r", "_c", "_wr", "_wc", "_f0", "_f1", "_f2", "_f3")


def _error(depth: str) -> Column:
    return F.median(F.abs(F.col(depth) - F.col("rendered")) / F.col("rendered"))


def refit(depths: DataFrame, rendered: DataFrame, factor: int = FACTOR, least: int = LEAST_PIXELS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(depths, report): depths (frame, v, u, depth, height, width) refitted to rendered (frame, v, u, rendered), and per
    frame its pixels, median errors before and after, and whether it was refitted.  Other frames stay as they are."""
    low = depths.where((F.col("depth") > 0) & (F.col("v") % factor == 0) & (F.col("u") % factor == 0))
    small = {"height": F.ceil(F.col("height") / factor).cast("int"), "width": F.ceil(F.col("width") / factor).cast("int")}
    low = low.withColumns({"v": (F.col("v") / factor).cast("int"), "u": (F.col("u") / factor).cast("int"), **small})
    pairs = low.join(rendered.where("rendered > 0"), ["frame", "v", "u"])
    enough = pairs.groupBy("frame").agg(F.count("*").alias("pixels"), _error("depth").alias("before"))
    pairs = cut(pairs.join(enough.where(F.col("pixels") >= least).select("frame"), "frame"))
    fit = cut(robust_affine(pairs.withColumns({"_x": 1 / F.col("depth"), "_y": 1 / F.col("rendered")}), ["frame"], "_x", "_y"))
    inverse = F.col("slope") / F.col("depth") + F.col("intercept")
    fitted = F.when(inverse > 1e-9, 1 / inverse).otherwise(0.0)
    left = pairs.join(fit, "frame").withColumn("_fit", fitted).where("_fit > 0").withColumn("value", F.log(F.col("rendered") / F.col("_fit")))
    field = block_means(left.where(F.abs("value") < OUTLIER).select("frame", "v", "u", "value", "height", "width"), block)
    sizes = pairs.select("frame", "height", "width").distinct()
    whole = sizes.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    step = upsampled(whole, field, "value").select("frame", F.col("v").alias("r"), F.col("u").alias("c"), "value", F.col("height").alias("rows"), F.col("width").alias("cols"))
    new = upsampled(depths.join(fit, "frame").where("depth > 0"), step).withColumn("refit", F.coalesce(fitted * F.exp("correction"), F.lit(0.0)))
    new = cut(new.select("frame", "v", "u", "refit"))
    at = new.where((F.col("v") % factor == 0) & (F.col("u") % factor == 0) & (F.col("refit") > 0)).select("frame", (F.col("v") / factor).cast("int").alias("v"), (F.col("u") / factor).cast("int").alias("u"), "refit")
    after = at.join(pairs.select("frame", "v", "u", "rendered"), ["frame", "v", "u"]).groupBy("frame").agg(_error("refit").alias("after"))
    report = cut(enough.join(after, "frame", "left").withColumn("refitted", F.coalesce(F.col("after") < F.col("before"), F.lit(False))))
    better = apart(new.join(report.where("refitted").select("frame"), "frame"))
    out = depths.join(better, ["frame", "v", "u"], "left").withColumn("depth", F.coalesce("refit", "depth")).select(depths.columns)
    return out, report


def refined(frames: DataFrame, depths: DataFrame, grid: Grid, far: Column | float, rounds: int = ROUNDS, factor: int = FACTOR, least: int = LEAST_PIXELS, colours: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """Depths after rounds of fusing all frames, rendering the surface and refitting, and the reports of the rounds."""
    sized = depths.join(frames.select("frame", "height", "width"), "frame")
    reports = []
    for _ in range(rounds):
        points = cut(surface(fuse_frames(frames, sized, grid, far, colours), grid, colours=colours))
        sized, report = refit(sized, render(points, frames, grid, far, factor), factor, least)
        sized = cut(sized)
        reports.append(report)
    return sized.select(depths.columns), reports
