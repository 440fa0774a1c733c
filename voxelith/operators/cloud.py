"""Filtering, levelling and sampling of point clouds.  Points are only dropped, or turned as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.aggregates import mad
from voxelith.operators.lineage import cut
from voxelith.operators.neighbors import nearest_folded, within

EPS = 2.220446049250313e-16


def bounds(df: DataFrame, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """One row: least and greatest coordinates, and the diagonal."""
    out = df.agg(*(f(n).alias(f"{k}_{n}") for n in xyz for k, f in (("min", F.min), ("max", F.max))))
    d = sum(((F.col(f"max_{n}") - F.col(f"min_{n}")) * (F.col(f"max_{n}") - F.col(f"min_{n}")) for n in xyz), F.lit(0.0))
    return out.withColumn("diagonal", F.sqrt(d))


def density_filter(df: DataFrame, radius: float, key: str, least: int = 3, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Rows with at least ``least`` rows (themselves too) within the radius."""
    return df.join(within(df, df, radius, key, xyz).where(F.col("neighbours") >= least).select(key), key, "left_semi")


def mean_distance(df: DataFrame, key: str, k: int, radius: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Mean distance to the k nearest rows, the row itself being one of them."""
    mean = (F.sum(F.sqrt("d2")) / F.count("*")).alias("mean_d")
    return nearest_folded(df, df, k, radius, key, [mean], xyz).withColumnRenamed("a", key)


def outlier_filter(means: DataFrame, times: float = 6.0) -> DataFrame:
    """Rows whose mean distance is at most median + times * max(MAD, eps)."""
    means = cut(means)
    limit = mad(means, [], "mean_d").select((F.col("med") + times * F.greatest("mad", F.lit(EPS))).alias("_limit"))  # one row
    return means.crossJoin(F.broadcast(limit)).where(F.col("mean_d") <= F.col("_limit")).drop("_limit")


def unless_abandoned(before: DataFrame, after: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """after, or before if under ``least`` of its rows are left."""
    after = cut(after.select(key))
    n = before.agg(F.count("*").alias("_b")).crossJoin(after.agg(F.count("*").alias("_a")))  # one row
    rows = before.join(after.select(key, F.lit(True).alias("_in")).distinct(), key, "left").crossJoin(F.broadcast(n))
    return rows.where(F.col("_in").isNotNull() | (F.col("_a") < least * F.col("_b"))).drop("_in", "_a", "_b")


def ranked(df: DataFrame, order: list[str], as_: str = "rn", parts: int = 64) -> DataFrame:
    """df with its row number from 0 in the given total order: sorted by ranges, counted per range, then offset, so no
    task sees all rows."""
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = cut(df.repartitionByRange(max(int(n), 1), *order).withColumn("_p", F.spark_partition_id()))  # planned once: ranges are drawn from a sample
    own = placed.withColumn(as_, F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return own.join(F.broadcast(before), "_p").withColumn(as_, (F.col(as_) + F.col("_o")).cast("bigint")).drop("_p", "_o")


def preview_sample(df: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """At most ``limit`` rows, evenly spaced in the order: those of numbers trunc(i * (n - 1) / (limit - 1))."""
    n = df.count()
    if n <= limit:
        return df
    picks = df.sparkSession.range(limit).select(F.floor(F.col("id") * (n - 1) / (limit - 1)).cast("bigint").alias("rn")).distinct()
    return ranked(df, order).join(F.broadcast(picks) if limit <= 100_000 else picks, "rn", "left_semi").drop("rn")


def every_kth(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    return ranked(df, order).where(F.col("rn") % k == 0).drop("rn")


def histogram_peak(df: DataFrame, value: str, width: float, share_above: float) -> DataFrame:
    """One row: the fullest bin (the lowest, on ties) above which at least share_above of the rows lie."""
    bins = df.groupBy(F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    run = Window.orderBy("bin")  # bins, not rows
    shares = bins.select("bin", "n", F.sum("n").over(run).alias("_c"), F.sum("n").over(Window.partitionBy()).alias("_t"))
    above = shares.where(1 - F.col("_c") / F.col("_t") >= share_above)
    return above.agg(F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin"))).alias("m")).select("m.*")


def tilt_search(df: DataFrame, tilts: DataFrame, width: float) -> DataFrame:
    """One row: the tilt (tx, tz slopes) whose fullest height bin is fullest; the first tilt on ties.

    tilts is the search grid (at most some 1,700 rows, by its construction) and is broadcast; counts are combined before
    they are exchanged."""
    h = F.floor((F.col("y") + F.col("x") * F.col("tx") + F.col("z") * F.col("tz")) / width).cast("int")
    bins = df.crossJoin(F.broadcast(tilts)).groupBy("tilt", h.alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy("tilt").agg(F.max("n").alias("n"))
    return best.agg(F.max_by(F.struct("tilt", "n"), F.struct("n", -F.col("tilt"))).alias("m")).select("m.*")


def gaussian_taps(reach: int = 6, sigma: float = 2.0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian kernel for `circular_peak`."""
    import math

    return [(o, math.exp(-0.5 * (o / sigma) ** 2)) for o in range(-reach, reach + 1)]


def circular_peak(df: DataFrame, bin_: str, weight: str, kernel: list[tuple[int, int]], bins: int = 360) -> DataFrame:
    """One row: the bin of the greatest smoothed weight; smoothing wraps around; the lowest bin on ties."""
    hist = df.groupBy(bin_).agg(F.sum(weight).alias("w"))
    taps = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(k).alias("k")) for o, k in kernel)))
    smooth = hist.withColumn("_t", taps).groupBy(F.pmod(F.col(bin_) + F.col("_t.o"), F.lit(bins)).alias("bin")).agg(F.sum(F.col("w") * F.col("_t.k")).alias("s"))
    return smooth.agg(F.max_by(F.struct("bin", "s"), F.struct("s", -F.col("bin"))).alias("m")).select("m.*")


def floor_layer(df: DataFrame, layer: str, share: float = 0.3) -> DataFrame:
    """One row: the lowest layer whose count, summed with both neighbours', is at least share of the greatest such sum."""
    counts = df.groupBy(F.col(layer).alias("layer")).agg(F.count("*").alias("n"))
    moved = counts.select(F.explode(F.array(F.col("layer") - 1, F.col("layer"), F.col("layer") + 1)).alias("layer"), "n")
    summed = moved.groupBy("layer").agg(F.sum("n").alias("s"))
    top = summed.agg(F.max("s").alias("_m"))
    return summed.crossJoin(F.broadcast(top)).where(F.col("s") >= share * F.col("_m")).agg(F.min_by(F.struct("layer", "s"), "layer").alias("m")).select("m.*")


def moments(df: DataFrame, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """One row: count, sums and sums of products, from which a 3x3 covariance follows on the driver."""
    a, b, c = xyz
    prods = [(p, q) for i, p in enumerate(xyz) for q in xyz[i:]]
    return df.agg(F.count("*").alias("n"), *(F.sum(n).alias(f"s_{n}") for n in (a, b, c)), *(F.sum(F.col(p) * F.col(q)).alias(f"s_{p}{q}") for p, q in prods))


def plane_normal(row) -> list[float]:
    """Direction of least spread, of a row of ``moments`` over x, y, z."""
    import numpy as np

    n = row["n"]
    s = np.array([row["s_x"], row["s_y"], row["s_z"]], float) / n
    m = np.array([[row["s_xx"], row["s_xy"], row["s_xz"]], [row["s_xy"], row["s_yy"], row["s_yz"]], [row["s_xz"], row["s_yz"], row["s_zz"]]], float) / n
    v = np.linalg.eigh(m - np.outer(s, s))[1][:, 0]
    return (v if v[1] >= 0 else -v).tolist()


def level(df: DataFrame, candidates: DataFrame, most_degrees: float = 10.0, least_rows: int = 500):
    """df turned so that the candidates' plane is level, or df itself if it tilts too far or too few rows support it."""
    import math

    from voxelith.functions.geometry import between_vectors, rotate

    row = moments(candidates).first()
    if row["n"] < least_rows:
        return df
    normal = plane_normal(row)
    if math.degrees(math.acos(max(-1.0, min(1.0, normal[1])))) > most_degrees:
        return df
    r = between_vectors(normal, [0.0, 1.0, 0.0])
    for names in (("x", "y", "z"), ("nx", "ny", "nz")):
        if set(names) <= set(df.columns):
            df = df.withColumns(dict(zip(names, rotate(*map(F.col, names), r), strict=True)))
    return df
