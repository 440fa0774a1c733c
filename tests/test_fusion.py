"""Fusion of depth frames and surfaces, against all pairs of cells and frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelith.operators.fusion import LEAST_CELLS, RELATIVE, Grid, frame_tiles, fuse_frames, gradients, surface


def rotation(rng):
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def scene(spark, seed, n=6, w=20, h=14):
    rng = np.random.default_rng(seed)
    frames, depth, colour = [], {}, {}
    for f in range(n):
        r, c = rotation(rng), rng.uniform(-1, 5, 3)
        t = -r @ c
        frames.append((f, *r.ravel().tolist(), *t.tolist(), 15.0, 16.0, w / 2 + 0.3, h / 2 - 0.4, w, h))
        d = rng.uniform(0.5, 6, (h, w)).astype(np.float32).astype(float)
        d[rng.random((h, w)) < 0.2] = 0
        depth[f], colour[f] = d, rng.integers(0, 256, (h, w, 3))
    names = "frame int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int"
    v, u = np.indices((h, w))
    pix = pd.concat(pd.DataFrame({"frame": f, "v": v.ravel(), "u": u.ravel(), "depth": depth[f].ravel(), **{k: colour[f][..., i].ravel() for i, k in enumerate(("red", "green", "blue"))}}) for f in range(n))
    return spark.createDataFrame(frames, names), spark.createDataFrame(pix), frames, depth, colour


def brute(grid, frames, depth, colour, far):
    out = {}
    cells = np.stack(np.meshgrid(*(np.arange(s) for s in grid.shape), indexing="ij"), -1).reshape(-1, 3)
    centre = np.array(grid.origin) + (cells + 0.5) * grid.size
    for f, *p in frames:
        r, t, (fx, fy, cx, cy, w, h) = np.array(p[:9]).reshape(3, 3), np.array(p[9:12]), p[12:]
        cam = centre @ r.T + t
        for cell, (x, y, z) in zip(map(tuple, cells.tolist()), cam.tolist()):
            if not 1e-6 < z <= far:
                continue
            u, v = round(fx * x / z + cx), round(fy * y / z + cy)
            if not (0 <= u < w and 0 <= v < h) or depth[f][v, u] <= 0:
                continue
            sdf, tr = depth[f][v, u] - z, max(RELATIVE * z, LEAST_CELLS * grid.size)
            o = out.setdefault(cell, [[], [], 0, 0])
            if sdf > -tr:
                o[0].append(min(sdf / tr, 1))
                if sdf < tr:
                    o[1].append(colour[f][v, u])
            o[2] += sdf > tr
            o[3] += sdf < -tr
    return out


@pytest.mark.parametrize("seed, far", [(0, 100.0), (1, 4.0)])
def test_fusion_equals_all_pairs_of_cells_and_frames(spark, seed, far):
    grid = Grid((-0.5, 0.0, -1.0), 0.3, (19, 9, 21))
    frames, pixels, *held = scene(spark, seed)
    fused = fuse_frames(frames, pixels, grid, far)
    want = brute(grid, *held, far)
    got = {(r.ix, r.iy, r.iz): r for r in fused.collect()}
    assert set(got) == set(want) and len(got) > 1000
    for cell, (values, near, free, occluded) in want.items():
        r = got[cell]
        assert (r.weight, r.near, r.free, r.occluded) == (len(values), len(near), free, occluded)
        assert abs(r.tsdf - (np.mean(values) if values else 1)) < 1e-9
        assert np.allclose((r.red, r.green, r.blue), np.mean(near, 0) if near else 0)
    plan = fused._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tiles_leave_out_what_a_frame_cannot_see(spark):
    grid = Grid((0.0, 0.0, 0.0), 0.1, (320, 320, 320))
    one = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, -16.0, -16.0, -16.0, 20.0, 20.0, 10.0, 10.0, 20, 20)], "frame int, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int")
    tiles = frame_tiles(one, grid, 8.0)
    assert tiles.where("_t2 < 19").count() == 0 and tiles.where("_t2 > 30").count() == 0  # behind the eye, beyond far
    assert tiles.count() < 0.5 * (10 + 2) ** 3 and tiles.where("_t0 = 19 and _t1 = 19").count() > 8


def sphere(spark, grid, centre, radius, weight=5):
    cells = np.stack(np.meshgrid(*(np.arange(s) for s in grid.shape), indexing="ij"), -1).reshape(-1, 3)
    p = np.array(grid.origin) + (cells + 0.5) * grid.size - centre
    sdf = np.linalg.norm(p, axis=1) - radius
    near = np.abs(sdf) < 3 * grid.size
    tsdf = np.clip(sdf / (3 * grid.size), -1, 1)
    rows = pd.DataFrame({"ix": cells[:, 0], "iy": cells[:, 1], "iz": cells[:, 2], "tsdf": tsdf, "weight": weight, "near": near.astype(int), "red": 10.0, "green": np.where(p[:, 0] > 0, 200.0, 0.0), "blue": 30.0})
    return spark.createDataFrame(rows), tsdf.reshape(grid.shape)


def test_a_sphere_is_found_within_half_a_cell(spark):
    grid = Grid((-1.0, -1.0, -1.0), 0.1, (20, 20, 20))
    volume, dense = sphere(spark, grid, np.array([0.03, -0.02, 0.01]), 0.6)
    g = gradients(volume, grid).toPandas().sort_values(["ix", "iy", "iz"])
    for axis, name in enumerate(("gx", "gy", "gz")):
        assert np.allclose(g[name].to_numpy().reshape(grid.shape), np.gradient(dense)[axis])
    s = surface(volume, grid).toPandas()
    away = s[["x", "y", "z"]].to_numpy() - [0.03, -0.02, 0.01]
    r = np.linalg.norm(away, axis=1)
    assert len(s) > 400 and np.abs(r - 0.6).max() < 0.05 and (np.sum(away / r[:, None] * s[["nx", "ny", "nz"]].to_numpy(), 1) > 0.97).all()
    assert set(s.axis) == {0, 1, 2} and (s.red.round(9) == 10).all() and s.green.between(-1e-6, 200 + 1e-6).all()
    assert surface(volume.withColumn("weight", F.lit(2)), grid).count() == 0 and surface(volume.withColumn("near", F.lit(0)), grid).count() == 0
