"""Depth refinement against dense arithmetic, and what it recovers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelith.operators.fusion import Grid
from voxelith.operators.refine import TAPS, blurred, block_means, refined, refit, render, upsampled
from tests.test_fusion import scene


def dense_blur(grid, passes):
    for _ in range(passes):
        for axis in (0, 1):
            padded = np.pad(grid, [(2, 2) if a == axis else (0, 0) for a in (0, 1)])
            grid = sum(t / 16 * np.take(padded, range(k, k + grid.shape[axis]), axis) for k, t in enumerate(TAPS))
    return grid


def dense_bilinear(field, height, width):
    out = np.zeros((height, width))
    for v in range(height):
        for u in range(width):
            y, x = ((k + 0.5) * n / m - 0.5 for k, n, m in ((v, field.shape[0], height), (u, field.shape[1], width)))
            y, x = min(max(y, 0), field.shape[0] - 1), min(max(x, 0), field.shape[1] - 1)
            a, b = int(y), int(x)
            c, d = min(a + 1, field.shape[0] - 1), min(b + 1, field.shape[1] - 1)
            out[v, u] = (field[a, b] * (1 - x + b) + field[a, d] * (x - b)) * (1 - y + a) + (field[c, b] * (1 - x + b) + field[c, d] * (x - b)) * (y - a)
    return out


def test_blocks_are_blurred_and_upsampled_as_arrays_are(spark):
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (2, 7), (9, 5)):
        a = rng.random(shape)
        assert np.allclose(blurred(a, 12), dense_blur(a, 12))
    h, w, block = 37, 50, 8
    values, there = rng.normal(size=(h, w)), rng.random((h, w)) < 0.3
    there[:20] = False
    rows = [(4, int(v), int(u), float(values[v, u]), h, w) for v, u in np.argwhere(there)]
    field = block_means(spark.createDataFrame(rows, "frame int, v int, u int, value double, height int, width int"), block)
    n = -(-h // block), -(-w // block)
    s, c = np.zeros(n), np.zeros(n)
    for v, u in np.argwhere(there):
        s[v // block, u // block] += values[v, u]
        c[v // block, u // block] += 1
    s, c = dense_blur(s, 12), dense_blur(c, 12)
    want = np.where(c > 1e-12, s / np.maximum(c, 1e-12), 0)
    got = np.zeros(n)
    for r in field.collect():
        got[r.r, r.c] = r.value
    assert np.allclose(got, want)
    targets = spark.range(h * w).selectExpr("4 as frame", f"cast(id div {w} as int) as v", f"cast(id % {w} as int) as u", f"{h} as height", f"{w} as width").union(spark.sql("select 5, 0, 0, 3, 3"))
    up = np.zeros((h, w))
    for r in upsampled(targets, field).collect():
        if r.frame == 4:
            up[r.v, r.u] = r.correction
        else:
            assert r.correction == 0
    assert np.allclose(up, dense_bilinear(want, h, w))


def test_rendering_is_the_nearest_point_of_each_pixel(spark):
    frames, _, held, *_ = scene(spark, 5)
    grid, rng = Grid((-2.0, -2.0, -2.0), 0.25, (36, 36, 36)), np.random.default_rng(9)
    points = rng.uniform(-2, 7, (4000, 3))
    want = {}
    for f, *p in held:
        r, t, (fx, fy, cx, cy, w, h) = np.array(p[:9]).reshape(3, 3), np.array(p[9:12]), p[12:]
        for x, y, z in (points @ r.T + t).tolist():
            if 1e-6 < z <= 9:
                u, v = int(np.floor((fx * x / z + cx) / 4)), int(np.floor((fy * y / z + cy) / 4))
                if 0 <= u < -(-w // 4) and 0 <= v < -(-h // 4):
                    want[f, v, u] = min(z, want.get((f, v, u), 1e9))
    got = {(r.frame, r.v, r.u): r.rendered for r in render(spark.createDataFrame(pd.DataFrame(points, columns=list("xyz"))), frames, grid, 9.0).collect()}
    assert set(got) == set(want) and len(got) > 30 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_scale_and_offset_are_recovered_and_good_frames_stay(spark):
    rng = np.random.default_rng(1)
    h, w = 96, 128
    v, u = np.indices((h, w))
    true = 3 + 0.5 * np.sin(u / 20) + 0.4 * np.cos(v / 15)
    maps = {0: true * 1.0, 1: 1 / (1.25 / true - 0.05), 2: true * np.exp(0.06 * np.sin(u / 30)), 3: true.copy()}
    maps[3][rng.random((h, w)) < 0.997] = 0  # too few pixels
    pix = pd.concat(pd.DataFrame({"frame": f, "v": v.ravel(), "u": u.ravel(), "depth": m.ravel(), "height": h, "width": w}) for f, m in maps.items())
    low = pd.concat(pd.DataFrame({"frame": f, "v": v[::4, ::4].ravel() // 4, "u": u[::4, ::4].ravel() // 4, "rendered": true[::4, ::4].ravel()}) for f in maps)
    out, report = refit(spark.createDataFrame(pix), spark.createDataFrame(low))
    seen = {r.frame: r for r in report.collect()}
    assert not seen[0].refitted and seen[1].refitted and seen[2].refitted and not seen[3].refitted
    assert seen[1].after < 0.01 < 0.05 < seen[1].before and seen[2].after < seen[2].before / 2
    back = out.toPandas().set_index(["frame", "v", "u"]).depth
    for f, most in ((0, 0), (1, 0.01), (2, 0.03)):
        d = back[f].unstack().to_numpy()
        assert np.median(np.abs(d - maps[0]) / maps[0]) <= most
    assert (back[3].unstack().to_numpy() == maps[3]).all() and len(back) == 4 * h * w


def test_rounds_bring_frames_of_a_wall_together(spark):
    h, w = 48, 64
    v, u = np.indices((h, w))
    frames, maps = [], []
    for f, scale in enumerate((1.0, 1.0, 1.06, 1.0, 0.95)):
        frames.append((f, *np.eye(3).ravel().tolist(), -0.05 * f, 0.0, 0.0, 60.0, 60.0, w / 2, h / 2, w, h))
        maps.append(pd.DataFrame({"frame": f, "v": v.ravel(), "u": u.ravel(), "depth": np.full(h * w, 2.0 * scale)}))
    names = "frame int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int"
    depths = spark.createDataFrame(pd.concat(maps))
    out, reports = refined(spark.createDataFrame(frames, names), depths, Grid((-1.5, -1.0, 1.0), 0.05, (60, 40, 30)), 4.0, rounds=2, least=50)
    spread = lambda df: df.groupBy("frame").agg(F.median("depth").alias("d")).agg(F.max("d") - F.min("d")).first()[0]
    assert len(reports) == 2 and reports[0].where("refitted").count() >= 2 and spread(out) < spread(depths) / 3 and out.count() == depths.count()
