"""The world's up direction from the poses of cameras that are held upright."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Second moment from which right axes span a plane; the direction without an estimate.
LEAST_SPREAD, DEFAULT = 0.02, (0.0, 1.0, 0.0)


def up_vector(poses: DataFrame) -> tuple[tuple[float, float, float], str]:
    """(unit up vector, how it was found) of poses with world-to-camera rotations r00 to r22 (rows: right, down, forward).

    ``right axes``: upright cameras' right axes are horizontal, so up is the direction in which they vary least, the last
    eigenvector of their second moments.  ``up axes``: where they span no plane (a straight strafe), the mean of the up axes
    without its part along the right axes.  Both point to the side of the mean up axis.  ``default``: +Y, if nothing is left
    of that mean or there is no pose.  Nine sums come to the driver, whatever the number of poses; poses with a null or
    non-finite entry are left out."""
    right, up = ([F.col(f"r{i}{j}") * sign for j in range(3)] for i, sign in ((0, 1), (1, -1)))
    whole = F.lit(True)
    for c in (*right, *up):
        whole = whole & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    n, *sums = poses.where(whole).agg(F.count("*"), *(F.sum(right[a] * right[b]) for a, b in pairs), *(F.sum(u) for u in up)).first()
    if not n:
        return DEFAULT, "default"
    moments, mean = np.zeros((3, 3)), np.array(sums[6:]) / n
    for (a, b), s in zip(pairs, sums, strict=False):
        moments[a, b] = moments[b, a] = s / n
    values, vectors = np.linalg.eigh(moments)
    v, how = (vectors[:, 0], "right axes") if values[1] >= LEAST_SPREAD else (mean - (mean @ vectors[:, 2]) * vectors[:, 2], "up axes")
    length = np.linalg.norm(v)
    if length < 1e-9:
        return DEFAULT, "default"
    return tuple((np.where(v @ mean < 0, -1.0, 1.0) * v / length).tolist()), how
