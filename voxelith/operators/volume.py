"""Sparse volumes: fusion, surfaces, components, morphology, shells.  Grids are relations of cells and are never densified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.grid import FACES, offsets
from voxelith.operators.lineage import cut

IX = ("ix", "iy", "iz")
#: Rounds of growing or shrinking after which the lineage is cut.
CUT_ROUNDS = 4
SQUARE = [(1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 0, -1)]


def fuse(samples: DataFrame, truncation: str = "trunc") -> DataFrame:
    """Truncated signed distances: per cell the mean of least(sdf / trunc, 1) over samples above -trunc, its weight (their
    count), and votes for free and occluded."""
    t = F.col(truncation)
    seen = F.col("sdf") > -t
    return samples.groupBy(*IX).agg(
        F.avg(F.when(seen, F.least(F.col("sdf") / t, F.lit(1.0)))).alias("tsdf"), F.count_if(seen).alias("weight"),
        F.count_if(F.col("sdf") > t).alias("free"), F.count_if(F.col("sdf") < -t).alias("occluded"), F.count_if(F.abs("sdf") <= t).alias("near"),
    )


def crossings(volume: DataFrame, least: int = 3) -> DataFrame:
    """(axis, cell, frac): where the distance changes sign between a cell and its neighbour along an axis."""
    out = None
    solid = volume.where(F.col("weight") >= least).select(*IX, "tsdf")
    for axis, i in enumerate(IX):
        far = solid.select(*(F.col(n) - (1 if n == i else 0) for n in IX), F.col("tsdf").alias("_t")).toDF(*IX, "_t")
        pair = solid.join(far, list(IX)).where((F.col("tsdf") * F.col("_t") < 0) & (F.abs(F.col("tsdf") - F.col("_t")) <= 1))
        part = pair.select(F.lit(axis).alias("axis"), *IX, (F.col("tsdf") / (F.col("tsdf") - F.col("_t"))).alias("frac"))
        out = part if out is None else out.unionByName(part)
    return out


def components(cells: DataFrame, steps: list[tuple[int, int, int]] = FACES) -> DataFrame:
    """cells with ``label``, the smallest key of their component.

    Labels travel to neighbours and jump to their own labels' labels, so rounds follow the logarithm of a component's
    length; each round's table is cut from its lineage."""
    key = F.struct(*IX)
    label = cut(cells.select(*IX).distinct().withColumn("label", key))
    edges = cut(offsets(label.select(*IX, F.struct(*IX).alias("src")), IX, steps).join(label.select(*IX), list(IX), "left_semi"))
    while True:
        near = edges.join(label.select(F.struct(*IX).alias("src"), "label"), "src").groupBy(*IX).agg(F.min("label").alias("_n"))
        least = cut(label.join(near, list(IX), "left").select(*IX, F.least("label", F.coalesce("_n", "label")).alias("label")))
        jump = least.select(F.struct(*IX).alias("_at"), F.col("label").alias("_to"))
        new = cut(least.join(jump, F.col("label") == F.col("_at"), "left").select(*IX, F.least("label", F.coalesce("_to", "label")).alias("label")))
        moved = new.join(label.withColumnRenamed("label", "_was"), list(IX)).where(F.col("label") != F.col("_was")).limit(1).count()
        label = new
        if not moved:
            return label


def largest(labels: DataFrame) -> DataFrame:
    top = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    return labels.join(F.broadcast(top), "label", "left_semi")


def seeded(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """The cells of the component that holds most seeds (rows of ix, iy, iz; one each), the largest label on ties; none if no seed is in a cell."""
    held = labels.join(seeds.select(*IX), list(IX)).groupBy("label").agg(F.count("*").alias("n"))
    top = held.agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    return labels.join(F.broadcast(top), "label", "left_semi")


def dilate(cells: DataFrame, times: int = 1, mask: DataFrame | None = None, steps: list[tuple[int, int, int]] = FACES) -> DataFrame:
    """Cells and their neighbours, round by round; neighbours outside the mask are not entered.

    Every round reads its input once (a cell moves by no step too), and the lineage is cut every CUT_ROUNDS rounds; a mask
    that several rounds read is written once."""
    out = cells.select(*IX).distinct()
    if mask is not None:
        mask = mask.select(*IX).distinct().withColumn("_m", F.lit(True))
        mask = cut(mask) if times > 1 else mask
    for i in range(times):
        own = out.withColumn("_o", F.struct(*IX))
        grown = offsets(own, IX, [(0, 0, 0), *steps]).groupBy(*IX).agg(F.max(F.col("_o") == F.struct(*IX)).alias("_in"))
        if mask is not None:
            grown = grown.join(mask, list(IX), "left").where("_in or _m")
        out = grown.select(*IX)
        out = cut(out) if (i + 1) % CUT_ROUNDS == 0 and i + 1 < times else out
    return out


def erode(cells: DataFrame, times: int = 1, steps: list[tuple[int, int, int]] = FACES) -> DataFrame:
    """Cells all of whose neighbours are cells; outside counts as empty."""
    out = cells.select(*IX).distinct()
    for i in range(times):
        moved = offsets(out.withColumn("_o", F.struct(*IX)), IX, [(0, 0, 0), *steps])
        whole = moved.groupBy(*IX).agg(F.count("*").alias("_n"), F.max(F.col("_o") == F.struct(*IX)).alias("_in"))
        out = whole.where((F.col("_n") == len(steps) + 1) & F.col("_in")).select(*IX)
        out = cut(out) if (i + 1) % CUT_ROUNDS == 0 and i + 1 < times else out
    return out


def opened(cells: DataFrame, times: int = 2) -> DataFrame:
    return dilate(erode(cells, times, SQUARE), times, steps=SQUARE)


def closed(cells: DataFrame, times: int = 3) -> DataFrame:
    return erode(dilate(cells, times, steps=SQUARE), times, SQUARE)


def fill_holes(cells: DataFrame) -> DataFrame:
    """A flat footprint (iy constant) and the empty cells of its box that do not reach the box's border."""
    box = cells.agg(*(f(n).alias(f"{k}{n}") for n in ("ix", "iz") for k, f in (("a", F.min), ("b", F.max))), F.min("iy").alias("iy"))
    whole = box.select("*", F.explode(F.sequence(F.col("aix") - 1, F.col("bix") + 1)).alias("ix")).select("*", F.explode(F.sequence(F.col("aiz") - 1, F.col("biz") + 1)).alias("iz"))
    empty = cut(whole.join(cells.select(*IX), list(IX), "left_anti").select(*IX))
    label = components(empty, SQUARE)
    outer = label.join(F.broadcast(box.select(F.struct((F.col("aix") - 1).alias("ix"), "iy", (F.col("aiz") - 1).alias("iz")).alias("_c"))), F.struct(*IX) == F.col("_c"), "left_semi").select("label")
    return cells.select(*IX).union(label.join(F.broadcast(outer), "label", "left_anti").select(*IX))


def shell(inside: DataFrame) -> DataFrame:
    """Cells next to the inside, with the first direction (order +x, +y, +z, -x, -y, -z) that faces it as normal, and the kind of surface."""
    order = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), *(F.lit(v).alias(n) for n, v in zip(("nx", "ny", "nz"), s, strict=True))) for i, s in enumerate(order))))
    moved = inside.select(*IX).distinct().withColumn("_d", parts)
    cells = moved.select(*((F.col(i) - F.col(f"_d.{n}")).alias(i) for i, n in zip(IX, ("nx", "ny", "nz"), strict=True)), "_d")
    out = cells.join(inside.select(*IX), list(IX), "left_anti").groupBy(*IX).agg(F.min_by("_d", "_d.rank").alias("d"))
    kind = F.when(F.col("ny") > 0.7, "floor").when(F.col("ny") < -0.7, "ceiling").otherwise("wall")
    return out.select(*IX, "d.nx", "d.ny", "d.nz").withColumn("kind", kind)


def sliding(df: DataFrame, value: str, along: str, across: list[str], reach: int, func) -> DataFrame:
    """func of value over ``reach`` places to both sides along one axis (by place, not by row)."""
    w = Window.partitionBy(*across).orderBy(along).rangeBetween(-reach, reach)
    return df.withColumn(value, func(value).over(w))


def grey_closing(df: DataFrame, value: str, a: str, b: str, reach: int = 15) -> DataFrame:
    """Greatest, then least, over a square window, axis by axis."""
    for func in (F.max, F.min):
        df = sliding(sliding(df, value, a, [b], reach, func), value, b, [a], reach, func)
    return df


def harmonic_fill(df: DataFrame, known: str, height: str, group: str, pull: float = 1e-6) -> DataFrame:
    """Per group of (a, b) cells: heights of the unknown cells by the Laplace equation with a slight pull to the mean of
    the known.  One group is one footprint (up to some 100,000 cells) and is solved in one task by conjugate gradients."""
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        fixed = pdf[known].to_numpy(bool)
        h = pdf[height].to_numpy(float).copy()
        if fixed.all() or not fixed.any():
            return pdf.assign(**{height: np.where(fixed, h, 0.0)})
        mean, at = h[fixed].mean(), {c: i for i, c in enumerate(zip(pdf.a, pdf.b, strict=True))}
        pairs = [(i, at[c]) for (a, b), i in at.items() for c in ((a + 1, b), (a, b + 1)) if c in at]
        i, j = np.array(pairs, int).reshape(-1, 2).T
        free = ~fixed
        degree = np.bincount(i, minlength=len(h)) + np.bincount(j, minlength=len(h)) + pull

        def apply(x):
            y = degree * x
            np.subtract.at(y, i, x[j])
            np.subtract.at(y, j, x[i])
            return np.where(free, y, 0.0)

        x = np.where(fixed, h, mean)
        r = np.where(free, pull * mean, 0.0) - apply(x)
        p, rr = r.copy(), r @ r
        for _ in range(4 * len(h)):
            if rr < 1e-18:
                break
            q = apply(p)
            step = rr / (p @ q)
            x, r = x + step * p, r - step * q
            rr, old = r @ r, rr
            p = r + rr / old * p
        return pdf.assign(**{height: np.where(fixed, h, x)})

    return df.groupBy(group).applyInPandas(solve, df.schema)


def block_field(df: DataFrame, block: int = 24, passes: int = 12) -> DataFrame:
    """Smoothed block means of a correction: sums and counts are each spread by [1 4 6 4 1] along both axes, then divided."""
    cells = df.groupBy("frame", F.floor(F.col("v") / block).cast("int").alias("bv"), F.floor(F.col("u") / block).cast("int").alias("bu")).agg(F.sum("value").alias("s"), F.count("value").cast("double").alias("n"))
    taps = [(-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)]
    edge = cells.groupBy("frame").agg(F.max("bv").alias("_mv"), F.max("bu").alias("_mu"))
    for _ in range(passes):
        for axis, most in (("bv", "_mv"), ("bu", "_mu")):
            t = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(k / 16).alias("k")) for o, k in taps)))
            moved = cells.withColumn("_t", t).withColumn(axis, F.col(axis) + F.col("_t.o")).join(edge, "frame").where(F.col(axis).between(F.lit(0), F.col(most)))
            cells = moved.groupBy("frame", "bv", "bu").agg(F.sum(F.col("s") * F.col("_t.k")).alias("s"), F.sum(F.col("n") * F.col("_t.k")).alias("n"))
    return cells.withColumn("field", F.try_divide("s", "n"))
