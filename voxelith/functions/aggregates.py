"""Order statistics and robust fits that the engine has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lower_median(c: str, kind: str = "int") -> Column:
    """The element of rank (n - 1) // 2, never interpolated."""
    return F.expr(f"percentile_disc(0.5) within group (order by {c})").cast(kind)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, ties: list[str], as_: str) -> DataFrame:
    """Per key the first value, in order of value and ties, at which the running weight reaches half of the total."""
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0)
    at = df.select(*keys, value, *ties, (2 * F.sum(weight).over(run) >= F.sum(weight).over(whole)).alias("_hit"))
    order = F.struct(value, *ties)
    return at.where("_hit").groupBy(*keys).agg(F.min_by(F.col(value), order).alias(as_))


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, med, mad): median, and median of distances from it."""
    if keys:
        med = df.groupBy(*keys).agg(F.median(value).alias("med"))
        return df.join(med, keys).groupBy(*keys, "med").agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    med = df.agg(F.median(value).alias("med"))  # one row
    return df.crossJoin(F.broadcast(med)).groupBy("med").agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))


def robust_affine(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 4, cut: float = 3.0) -> DataFrame:
    """(keys, slope, intercept): least squares, refitted to the rows whose residual is under cut * 1.4826 * MAD.

    The MAD is that of the rows kept so far; the mask is over all rows.  A MAD of 0 keeps what lies on the line.
    Rows of one x have the solution of least norm."""
    from voxelith.operators.lineage import cut as materialised

    rows = df.withColumn("_keep", F.lit(True))
    fit = None
    for i in range(rounds):
        kept = F.when(F.col("_keep"), F.col(y)), F.when(F.col("_keep"), F.col(x))
        mx, my = F.avg(kept[1]), F.avg(kept[0])
        fit = rows.groupBy(*keys).agg(F.coalesce(F.regr_slope(*kept), mx * my / (mx * mx + 1)).alias("slope"), F.coalesce(F.regr_intercept(*kept), my / (mx * mx + 1)).alias("intercept"))
        if i == rounds - 1:
            break
        res = rows.join(fit, keys).withColumn("_r", F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))))
        med = res.where("_keep").groupBy(*keys).agg(F.median("_r").alias("_m"))
        rows = materialised(res.join(med, keys).withColumn("_keep", F.col("_r") <= F.lit(cut * 1.4826) * F.col("_m") + 1e-9).select(*df.columns, "_keep"))  # else each round would read the last one's inputs twice
    return fit
