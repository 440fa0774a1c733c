"""Cells, neighbours and block-world coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
CUBE = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
SNAP = 2e-6


def cell(c: Column, origin: float, size: float, dim: int | None = None) -> Column:
    """Grid cell of a coordinate: within SNAP of a plane counts as on it, and the far face belongs to the last cell."""
    s = (c - F.lit(origin)) / F.lit(size)
    at = F.floor(F.when(F.abs(s - F.rint(s)) <= SNAP, F.rint(s)).otherwise(s))
    return (at if dim is None else F.least(at, F.lit(dim - 1))).cast("int")


def absolute_cell(c: Column, radius: float | Column) -> Column:
    return F.floor(c / radius).cast("int")


def linear_key(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    return (x.cast("bigint") * ny + y) * nz + z


def in_grid(dims: tuple[int, int, int], names: tuple[str, str, str] = ("ix", "iy", "iz")) -> Column:
    out = F.lit(True)
    for n, d in zip(names, dims, strict=True):
        out = out & (F.col(n) >= 0) & (F.col(n) < d)
    return out


def chunk(c: Column) -> Column:
    return F.shiftright(c, 4)


def region(c: Column) -> Column:
    return F.shiftright(c, 9)


def local_index(x: Column, y: Column, z: Column) -> Column:
    """Place in a 16x16x16 section, y slowest and x fastest."""
    return F.shiftleft(y.bitwiseAND(15), 8) + F.shiftleft(z.bitwiseAND(15), 4) + x.bitwiseAND(15)


def offsets(df: DataFrame, names: tuple[str, str, str], steps: list[tuple[int, int, int]], as_: tuple[str, str, str] | None = None) -> DataFrame:
    """df once for every step, with the cell moved by it (a constant array is exploded; nothing is joined)."""
    moved = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("_dx", "_dy", "_dz"), s, strict=True))) for s in steps)))
    out = df.withColumn("_s", moved)
    for n, new, d in zip(names, as_ or names, ("_dx", "_dy", "_dz"), strict=True):
        out = out.withColumn(new, F.col(n) + F.col(f"_s.{d}"))
    return out.drop("_s")


def canonical_order(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Chunk by chunk (x, then z), section by section, then y, z, x."""
    cx, cy, cz = F.col(x), F.col(y), F.col(z)
    return [chunk(cx), chunk(cz), chunk(cy), cy, cz, cx]


def placement_order(x: str = "ix", y: str = "iy", z: str = "iz") -> list[Column]:
    cx, cy, cz = F.col(x), F.col(y), F.col(z)
    return [chunk(cx), chunk(cz), cy, cz, cx]
