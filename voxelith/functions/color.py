"""Colour conversions as column expressions (sRGB, linear light, CIE Lab under D65)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sRGB and CIE standards.
_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)


def to_linear(c: Column) -> Column:
    """Linear light of an sRGB value from 0 to 1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_srgb8(c: Column) -> Column:
    """8-bit sRGB of linear light, rounded half to even."""
    s = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return F.least(F.greatest(F.rint(s * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a, b of linear light."""

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)

    x, y, z = (f((r * m[0] + g * m[1] + b * m[2]) / w) for m, w in zip(_TO_XYZ, _WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_of_srgb8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return to_lab(*(to_linear(c / 255.0) for c in (r, g, b)))


def with_lab(df: DataFrame, rgb: tuple[str, str, str], names: tuple[str, str, str]) -> DataFrame:
    """df with Lab columns of 8-bit columns.  Each step is a projection of its own, so nothing is worked out twice and the
    generated code stays small."""
    df = df.withColumns({f"_l{i}": to_linear(F.col(c) / 255.0) for i, c in enumerate(rgb)})
    mixed = (sum((F.col(f"_l{i}") * k for i, k in enumerate(row)), F.lit(0.0)) / w for row, w in zip(_TO_XYZ, _WHITE, strict=True))
    df = df.withColumns(dict(zip(("_x0", "_x1", "_x2"), mixed, strict=True)))
    df = df.withColumns({f"_f{i}": F.when(F.col(f"_x{i}") > 216 / 24389, F.cbrt(f"_x{i}")).otherwise((24389 / 27 * F.col(f"_x{i}") + 16) / 116) for i in range(3)})
    x, y, z = (F.col(f"_f{i}") for i in range(3))
    lab = dict(zip(names, (116 * y - 16, 500 * (x - y), 200 * (y - z)), strict=True))
    return df.withColumns(lab).drop(*(f"_{k}{i}" for k in "lxf" for i in range(3)))
