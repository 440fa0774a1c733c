"""Geometry as column expressions over scalar coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def rigid(x: Column, y: Column, z: Column, matrix: Matrix) -> tuple[Column, Column, Column]:
    """Rotate and translate by a row-major 4x4 matrix."""
    return tuple(x * F.lit(float(r[0])) + y * F.lit(float(r[1])) + z * F.lit(float(r[2])) + F.lit(float(r[3])) for r in matrix[:3])


def rotate(x: Column, y: Column, z: Column, matrix: Matrix) -> tuple[Column, Column, Column]:
    """Directions turn and are not moved."""
    return tuple(x * F.lit(float(r[0])) + y * F.lit(float(r[1])) + z * F.lit(float(r[2])) for r in matrix[:3])


def quarter_turns(x: int = 0, y: int = 0, z: int = 0) -> list[list[int]]:
    """Rz Ry Rx of whole quarter turns, as an exact 4x4 matrix."""
    cos, sin = [1, 0, -1, 0], [0, 1, 0, -1]
    a, b = (cos[x % 4], sin[x % 4]), (cos[y % 4], sin[y % 4])
    c = (cos[z % 4], sin[z % 4])
    rx = [[1, 0, 0], [0, a[0], -a[1]], [0, a[1], a[0]]]
    ry = [[b[0], 0, b[1]], [0, 1, 0], [-b[1], 0, b[0]]]
    rz = [[c[0], -c[1], 0], [c[1], c[0], 0], [0, 0, 1]]
    mul = lambda p, q: [[sum(p[i][k] * q[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return [[*row, 0] for row in mul(rz, mul(ry, rx))] + [[0, 0, 0, 1]]


def check_rigid(matrix: Matrix, affine_tol: float = 1e-6, rotation_tol: float = 1e-5) -> None:
    """Raise unless the matrix is finite, affine, orthonormal and keeps handedness."""
    if len(matrix) != 4 or any(len(r) != 4 for r in matrix) or not all(math.isfinite(v) for r in matrix for v in r):
        raise ValueError("the transform needs 16 finite numbers")
    if any(abs(a - b) > affine_tol for a, b in zip(matrix[3], (0, 0, 0, 1), strict=True)):
        raise ValueError("the last row must be 0, 0, 0, 1")
    m = [r[:3] for r in matrix[:3]]
    for i in range(3):
        for j in range(3):
            if abs(sum(m[i][k] * m[j][k] for k in range(3)) - (i == j)) > rotation_tol:
                raise ValueError("the rotation must be orthonormal")
    det = sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))
    if abs(det - 1) > rotation_tol:
        raise ValueError("the rotation must keep handedness")


def between_vectors(a: Sequence[float], b: Sequence[float]) -> list[list[float]]:
    """The rotation that turns direction a into direction b; opposite directions turn about the x axis."""
    unit = lambda v: [c / math.sqrt(sum(d * d for d in v)) for c in v]
    a, b = unit(a), unit(b)
    w = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = sum(p * q for p, q in zip(a, b, strict=True))
    if c < -1 + 1e-12:
        return [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]]
    k = [[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]
    return [[(i == j) + k[i][j] + sum(k[i][n] * k[n][j] for n in range(3)) / (1 + c) for j in range(3)] for i in range(3)]


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Nine row-major entries of a unit quaternion's rotation."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def camera_centre(r: Sequence[Column], tx: Column, ty: Column, tz: Column) -> tuple[Column, Column, Column]:
    """Minus the transposed rotation times the translation."""
    return tuple(-(r[i] * tx + r[i + 3] * ty + r[i + 6] * tz) for i in range(3))


def project(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pinhole image coordinates of a camera-space point; null on or behind the camera."""
    front = F.when(z > 0, z)
    return fx * x / front + cx, fy * y / front + cy


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    return (u - cx) / fx * depth, (v - cy) / fy * depth, depth


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite (NaN sorts above infinity)."""
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def yaw_fold(degrees: Column) -> Column:
    """The angle that differs by quarter turns and lies in -45 to 45."""
    return F.pmod(degrees + 45, F.lit(90.0)) - 45
