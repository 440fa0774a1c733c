"""Keyframes, trajectories and depth maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.geometry import project
from voxelith.operators.fusion import over_tasks
from voxelith.operators.lineage import cut

#: Edge of the tiles of points, and of the blocks of cameras, that meet in ``visible``.
EDGE = 8.0
#: Tiles along an axis at most; tiles of wider clouds are larger, so that a few points far away cost no more.
TILES = 64


def usable(df: DataFrame, brightness: tuple[float, float] = (18, 238), clipped: float = 0.35, sharpness: float = 0.08) -> DataFrame:
    return df.where(F.col("brightness").between(*brightness) & (F.col("clipped") <= clipped) & (F.col("sharpness") >= sharpness))


def changes(df: DataFrame, value: str, order: list[str], keys: list[str], as_: str = "difference") -> DataFrame:
    """Absolute change from the row before; 1 for a session's first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(as_, F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(1.0)))


def keyframes(df: DataFrame, keys: list[str], order: list[str], id_: str, score: str, bins: int) -> DataFrame:
    """Per session: rows are cut into bins floor(b*n/T)..floor((b+1)*n/T); the best score of each stays, the first on ties."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    t = F.least(F.lit(bins), F.col("_n"))
    # bin of row i: the greatest b with floor(b*n/T) <= i
    b = F.floor((F.col("_i") * t + t - 1) / F.col("_n"))
    b = F.when(F.floor(b * F.col("_n") / t) > F.col("_i"), b - 1).otherwise(b)
    return rows.withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(F.max_by(id_, F.struct(score, -F.col("_i"))).alias(id_), F.count("*").alias("candidates"))


def step_ratios(df: DataFrame, keys: list[str], frame: str, xyz: tuple[str, str, str]) -> DataFrame:
    """Per session: greatest step per frame, and its ratio to the median of the steps that are not zero."""
    w = Window.partitionBy(*keys).orderBy(frame)
    d = F.lit(0.0)
    for n in xyz:
        e = F.col(n) - F.lag(n).over(w)
        d = d + e * e
    rows = df.select(*keys, (F.sqrt(d) / (F.col(frame) - F.lag(frame).over(w))).alias("step")).where("step is not null")
    out = rows.groupBy(*keys).agg(F.max("step").alias("greatest"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("typical"))
    return out.where("typical > 0").withColumn("ratio", F.col("greatest") / F.col("typical"))


def match_pairs(df: DataFrame, keys: list[str], frame: str, exhaustive: int = 100, near: int = 20) -> DataFrame:
    """Pairs of frame numbers (0..n-1 per session): all, up to ``exhaustive`` frames; else neighbours and powers of two away."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"i": F.row_number().over(w.orderBy(frame)) - 1, "n": F.count("*").over(w)})
    powers = F.array(*(F.lit(1 << p) for p in range(31) if 1 << p > near))
    gaps = F.when(F.col("n") <= exhaustive, F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array())).otherwise(
        F.concat(F.sequence(F.lit(1), F.lit(near)), powers)
    )
    return rows.select(*keys, "i", "n", F.explode(gaps.cast("array<int>")).alias("g")).where(F.col("i") + F.col("g") < F.col("n")).select(*keys, "i", (F.col("i") + F.col("g")).alias("j"))


def drop_trajectory_outliers(steps: list[float], budget: float = 0.1, ratio: float = 8.0) -> list[int]:
    """Places kept of a short list of positions' step lengths: while the greatest step exceeds ratio times the median,
    its row goes, as long as the budget lasts.  Inherently sequential, over a few hundred frames at most."""
    import statistics

    kept = list(range(len(steps)))
    for _ in range(int(budget * len(steps))):
        own = [steps[i] for i in kept if steps[i] > 0]
        worst = max(kept, key=lambda i: (steps[i], -i), default=None)
        if not own or steps[worst] <= ratio * statistics.median(own):
            break
        kept.remove(worst)
    return kept


def quality_gate(df: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """df with ``failures``: names of the checks (name, SQL predicate that means failure) that fail, in order."""
    return df.withColumn("failures", F.array_compact(F.array(*(F.when(F.expr(p), F.lit(n)) for n, p in checks))))


def edge_filter(depth: DataFrame, most: float = 0.06, frame: str = "frame") -> DataFrame:
    """Pixels whose 3x3 valid neighbourhood spreads at most ``most`` of their depth."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    valid = depth.where("depth > 0")
    around = valid.withColumn("_s", steps).select(frame, (F.col("v") + F.col("_s.a")).alias("v"), (F.col("u") + F.col("_s.b")).alias("u"), F.col("depth").alias("_d"))
    spread = around.groupBy(frame, "v", "u").agg((F.max("_d") - F.min("_d")).alias("spread"))
    return valid.join(spread, [frame, "v", "u"]).where(F.col("spread") <= most * F.col("depth"))


def normals_from_depth(depth: DataFrame, fx: float, fy: float, cx: float, cy: float, frame: str = "frame") -> DataFrame:
    """Camera-facing unit normals by central differences; pixels without all four neighbours have none."""
    row, col = Window.partitionBy(frame, "v").orderBy("u"), Window.partitionBy(frame, "u").orderBy("v")
    p = depth.where("depth > 0").withColumns({"x": (F.col("u") - cx) / fx * F.col("depth"), "y": (F.col("v") - cy) / fy * F.col("depth"), "z": F.col("depth")})
    p = p.withColumns({f"{n}{k}": f(n).over(w) for n in "xyz" for k, f, w in (("l", F.lag, row), ("r", F.lead, row), ("t", F.lag, col), ("b", F.lead, col))} | {
        "_ok": (F.lag("u").over(row) == F.col("u") - 1) & (F.lead("u").over(row) == F.col("u") + 1) & (F.lag("v").over(col) == F.col("v") - 1) & (F.lead("v").over(col) == F.col("v") + 1)})
    a, b = ({n: F.col(f"{n}{k}") - F.col(f"{n}{m}") for n in "xyz"} for k, m in (("r", "l"), ("b", "t")))
    n = {"nx": a["y"] * b["z"] - a["z"] * b["y"], "ny": a["z"] * b["x"] - a["x"] * b["z"], "nz": a["x"] * b["y"] - a["y"] * b["x"]}
    p = p.where("_ok").select(frame, "v", "u", "x", "y", "z", *(e.alias(k) for k, e in n.items()))
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    away = F.when(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") > 0, -1.0).otherwise(1.0)
    return p.where(length > 0).select(frame, "v", "u", *((F.col(k) / length * away).alias(k) for k in n))


def z_buffer(points: DataFrame, frame: str = "frame", scale: int = 4) -> DataFrame:
    """Nearest depth of each coarse pixel."""
    return points.groupBy(frame, F.floor(F.col("v") / scale).cast("int").alias("v"), F.floor(F.col("u") / scale).cast("int").alias("u")).agg(F.min("depth").alias("depth"))


def visible(points: DataFrame, cameras: DataFrame, key: str, camera: str, on: str, focal: tuple[float, float], centre: tuple[float, float], size: tuple[int, int], edge: float = EDGE) -> DataFrame:
    """(camera, u, v, key, depth): the nearest point of each pixel, ties to the smaller key.  Points and cameras (x, y, z) of
    one value of ``on`` belong together; cameras look along z.

    Points in one place count as the one of least key, cameras in one place are taken once.  Cameras are dealt to blocks; a
    block meets the tiles that its cameras' view pyramids may touch, and each of its cameras the points of these.  All pixels
    of a block are in one part of the shuffle, so pairs are folded where they arise.  Points are numbered by z, then key: the
    least number is the nearest for every camera, and fits a hash aggregate, which a struct does not."""
    xyz = ("x", "y", "z")
    places = points.dropna(subset=[on, *xyz]).groupBy(on, *xyz).agg(F.min(key).alias(key)).orderBy("z", key)
    places = cut(places.withColumn("_o", F.monotonically_increasing_id()))
    ends = places.agg(*(f(n).cast("double") for n in xyz for f in (F.min, F.max))).first()
    span = {n: (a or 0.0, b or 0.0) for n, a, b in zip(xyz, ends[::2], ends[1::2], strict=True)}  # nothing to pair without points
    tile = max(edge, *((b - a) / TILES for a, b in span.values()))
    places = places.withColumns({f"_t{n}": F.floor(F.col(n) / tile) for n in xyz})
    own = cameras.dropna(subset=[on, *xyz]).select(on, camera, *(F.col(n).alias(f"_c{n}") for n in xyz))
    at = [on, *(f"_c{n}" for n in xyz)]
    poses = cut(own.select(*at).distinct().withColumn("_pose", F.monotonically_increasing_id()).withColumn("_b", F.struct(on, *(F.floor(F.col(f"_c{n}") / edge) for n in xyz))))
    ends = [f(f"_c{n}").alias(f"_{f.__name__}c{n}") for n in xyz for f in (F.min, F.max)]
    blocks = cut(poses.groupBy("_b", on).agg(*ends).withColumn("_block", F.monotonically_increasing_id()))

    # one pixel more on every side, for rounding; a pyramid that does not hold its axis begins on it
    low, high = ([o(s, 0.0) for s in ((b - c) / f for b, c, f in zip(bounds, centre, focal, strict=True))] for o, bounds in ((min, (-1, -1)), (max, (size[0] + 1, size[1] + 1))))
    tiles = over_tasks(blocks, "_block")
    reach = (F.col("_tz") + 1) * tile - F.col("_mincz")
    spans = {"z": (F.floor(F.col("_mincz") / tile), F.floor(F.lit(span["z"][1]) / tile))}
    spans |= {n: (F.floor((F.col(f"_minc{n}") + reach * a) / tile), F.floor((F.col(f"_maxc{n}") + reach * b) / tile)) for n, a, b in zip("xy", low, high, strict=True)}
    for n in "zxy":
        first, last = F.greatest(spans[n][0], F.floor(F.lit(span[n][0]) / tile)), F.least(spans[n][1], F.floor(F.lit(span[n][1]) / tile))
        tiles = tiles.where(first <= last).withColumn(f"_t{n}", F.explode(F.sequence(first, last)))
    near = tiles.join(places, [on, *(f"_t{n}" for n in xyz)])
    far = F.col("z") - F.col("_mincz")
    for n, a, b in zip("xy", low, high, strict=True):
        near = near.where((F.col(n) >= F.col(f"_minc{n}") + far * a) & (F.col(n) <= F.col(f"_maxc{n}") + far * b))
    near = over_tasks(near.where(far > 0).select("_block", *xyz, "_o", key), "_block")

    pairs = near.join(poses.join(F.broadcast(blocks.select("_b", "_block")), "_b").select("_block", "_pose", *at[1:]), "_block")
    pairs = pairs.select("_block", "_pose", "_o", key, *((F.col(n) - F.col(f"_c{n}")).alias(f"_d{n}") for n in xyz)).where("_dz > 0")
    for n, a, b in zip("xy", low, high, strict=True):  # products first, which cost less than quotients
        pairs = pairs.where((F.col(f"_d{n}") >= F.col("_dz") * a) & (F.col(f"_d{n}") <= F.col("_dz") * b))
    u, v = project(*(F.col(f"_d{n}") for n in xyz), *map(F.lit, (*focal, *centre)))
    pairs = pairs.select("_block", "_pose", "_o", key, u.alias("u"), v.alias("v"), F.col("_dz").alias("depth")).where((F.col("u") >= 0) & (F.col("u") < size[0]) & (F.col("v") >= 0) & (F.col("v") < size[1]))
    pixel = [F.floor(n).cast("int").alias(n) for n in "uv"]
    seen = pairs.groupBy("_block", "_pose", *pixel).agg(F.min_by(key, "_o").alias(key), F.min("depth").alias("depth"))
    names = cut(own.join(poses.select(*at, "_pose"), at).select("_pose", camera).distinct())
    out = seen.join(names, "_pose").select(camera, "u", "v", key, "depth")
    moved = cut(names.groupBy(camera).count().where("count > 1").select(camera))
    if moved.isEmpty():
        return out
    out = cut(out)  # a camera in several places has one picture
    nearest = out.join(moved, camera, "left_semi").groupBy(camera, "u", "v").agg(F.min(F.struct("depth", key)).alias("_m"))
    return out.join(moved, camera, "left_anti").union(nearest.select(camera, "u", "v", f"_m.{key}", "_m.depth"))


def predict_depth(images: DataFrame, predictor, schema: str) -> DataFrame:
    """Apply a user's batch predictor, (iterator of pandas frames) -> iterator of pandas frames; a model is loaded once a task."""
    return images.mapInPandas(predictor, schema)
