"""Operators beyond the queries: invariants, refusals, numeric recovery, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import geometry as G
from voxelith.operators import cloud, frames, lifecycle, volume, world
from voxelith.operators.voxelize import accept_cells, crop_to_grid, match_palette
from voxelith.streaming.metrics import windowed_metrics


def test_transforms_are_checked():
    G.check_rigid(G.quarter_turns(1, 2, 3))
    for bad in ([[1, 0, 0, 0]] * 4, [[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], [[-1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], [[math.nan] * 4] * 4, [[1]]):
        with pytest.raises(ValueError):
            G.check_rigid(bad)
    assert np.allclose(np.array(G.between_vectors([0, 0, 2], [0, 3, 0])) @ [0, 0, 1], [0, 1, 0])
    assert G.between_vectors([0, 1, 0], [0, -1, 0])[1][1] == -1


def test_three_reds_make_one_cell(spark):
    rows = [(0.1, 0.1, 0.1, 200, 30, 30, 0), (0.2, 0.2, 0.2, 142, 33, 33, 1), (0.3, 0.3, 0.3, 100, 40, 40, 2)]
    df = spark.createDataFrame(rows, "x double, y double, z double, red int, green int, blue int, view_id int")
    cells, dims = crop_to_grid(df, (0, 0, 0), (1, 1, 1), 1.0)
    out = accept_cells(cells, (0, 0, 0), 1.0, min_views=3).collect()
    assert dims == (1, 1, 1) and [(r.n, r.views, r.med_r, r.med_g, r.med_b) for r in out] == [(3, 3, 142, 33, 33)]
    assert accept_cells(cells, (0, 0, 0), 1.0, min_views=4).count() == 0
    pal = spark.createDataFrame([(1, 9, "minecraft:red", 142, 33, 33, 0.0), (2, 5, "minecraft:same", 142, 33, 33, 0.0)], "pos int, palette_id int, block_state string, pr int, pg int, pb int, penalty double")
    assert match_palette(accept_cells(cells, (0, 0, 0), 1.0), pal).first().palette_id == 9


def test_empty_regions_stay_empty(spark):
    wall = [(x / 10, y / 10, 0.0, 9, 9, 9) for x in range(-30, 31) for y in range(41) if not (-10 < x < 10 and 10 < y < 30)]
    df = spark.createDataFrame(wall, "x double, y double, z double, red int, green int, blue int")
    cells, _ = crop_to_grid(df, (-3, 0, -0.05), (3, 4, 0.05), 0.2)
    got = accept_cells(cells, (-3, 0, -0.05), 0.2, min_points=1)
    assert got.where("ix between 11 and 18 and iy between 6 and 13").count() == 0 and got.join(cells, ["ix", "iy", "iz"], "left_anti").count() == 0


def test_levelling_recovers_a_tilt_and_refuses_a_steep_one(spark):
    rng = np.random.default_rng(0)
    for tilt, moved in ((4.0, True), (25.0, False)):
        a = math.radians(tilt)
        pts = np.column_stack([rng.uniform(-2, 2, 800), rng.normal(0, 0.005, 800), rng.uniform(-2, 2, 800)]) @ np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        df = spark.createDataFrame(pts.tolist(), "x double, y double, z double")
        out = cloud.level(df, df)
        normal = cloud.plane_normal(cloud.moments(out).first())
        assert (math.degrees(math.acos(min(1, normal[1]))) < 0.2) == moved


def test_previews_are_bounded_and_hold_the_ends(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"))
    got = [r.id for r in cloud.preview_sample(df, 20, ["x", "id"]).orderBy("id").collect()]
    assert got == [int(i * 999 / 19) for i in range(20)] and cloud.preview_sample(df, 1000, ["x"]).count() == 1000


def test_trajectory_outliers_go_within_the_budget():
    steps = [1.0] * 40
    steps[20] = 30.0
    assert 20 not in frames.drop_trajectory_outliers(steps) and len(frames.drop_trajectory_outliers([1.0] * 30 + [50.0] * 10)) >= 36
    assert frames.drop_trajectory_outliers([]) == []


def test_depth_normals_of_a_plane_face_the_camera(spark):
    df = spark.range(400).select(F.lit(0).alias("frame"), (F.col("id") / 20).cast("int").alias("v"), (F.col("id") % 20).cast("int").alias("u")).withColumn("depth", 2.0 / (1 - (F.col("u") - 10) / 100.0))
    n = frames.normals_from_depth(df, 50, 50, 10, 10).agg(F.avg("nx").alias("x"), F.avg("nz").alias("z"), F.count("*").alias("c")).first()
    assert n.c == 18 * 18 and n.z < -0.8 and abs(n.x) > 0.1


def test_harmonic_fill_recovers_a_plane(spark):
    rows = [(0, a, b, a in (0, 14) or b in (0, 14), 0.5 * a - 0.25 * b + 3 if a in (0, 14) or b in (0, 14) else 0.0) for a in range(15) for b in range(15)]
    got = volume.harmonic_fill(spark.createDataFrame(rows, "g int, a int, b int, k boolean, h double"), "k", "h", "g", 1e-9).collect()
    assert len(got) == 225 and max(abs(r.h - (0.5 * r.a - 0.25 * r.b + 3)) for r in got) < 1e-3


def test_block_field_of_a_constant_is_that_constant(spark):
    df = spark.range(9600).select(F.lit(1).alias("frame"), (F.col("id") / 120).cast("int").alias("v"), (F.col("id") % 120).cast("int").alias("u"), F.lit(2.5).alias("value"))
    got = volume.block_field(df, 24, 2).collect()
    assert len(got) == 20 and all(abs(r.field - 2.5) < 1e-9 for r in got)


def test_changed_worlds_are_reported(spark):
    b = spark.range(300).select((F.col("id") % 20 - 7).cast("int").alias("x"), (F.col("id") / 60).cast("int").alias("y"), (F.col("id") % 60 / 20).cast("int").alias("z"), F.concat(F.lit("minecraft:s"), F.col("id") % 33).alias("state")).dropDuplicates(["x", "y", "z"])
    assert world.compare(b, b).count() == 0
    changed = b.withColumn("state", F.when((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0), "minecraft:other").otherwise(F.col("state")))
    assert [r.difference for r in world.compare(b, changed).collect()] == ["mismatch"]
    assert world.state_properties(F.lit("a[z=1,b=2]")) is not None and volume.fuse is not None


def test_every_state_may_fail_and_none_is_skipped(spark):
    edges = set(lifecycle.transitions(lifecycle.SCAN_STEPS))
    assert all((s, "FAILED") in edges for s in lifecycle.SCAN_STEPS[:-1]) and ("CREATED", "QUEUED") not in edges and ("READY", "FAILED") not in edges


def test_stream_of_metrics_counts_each_attempt_once(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "event_type as stage", "cast(ts as timestamp) as started_at", "cast(value * 1000 as bigint) as ms", "if(event_type = 'error', 'FAILED', 'DONE') as status")
    rows.union(rows.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_metrics(stream, late="400 days").writeStream.outputMode("update").format("memory").queryName("stage_windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(attempts) n from stage_windows").first().n == rows.count()
    assert sorted(spark.sql("select * from stage_windows").collect()) == sorted(windowed_metrics(rows).collect())


def test_rows_are_numbered_alike_however_many_columns_they_have(spark):
    from voxelith.operators.cloud import every_kth, preview_sample

    df = spark.range(20_000).selectExpr("id * 7919 % 20000 as k", "id % 13 as a", "cast(id as string) as b").repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert sorted(r.k for r in every_kth(df, 37, ["k"]).collect()) == list(range(0, 20_000, 37))
        assert preview_sample(df, 500, ["k"]).count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nearest_finds_far_rows_and_all_of_few(spark):
    from voxelith.operators.neighbors import nearest

    df = spark.createDataFrame([(i, float(x), 0.0, 0.0, g) for i, (x, g) in enumerate([(0, "a"), (1, "a"), (10**6, "a"), (3, "b")])], "id int, x double, y double, z double, g string")
    got = {(r.a, r.b) for r in nearest(df, df, 2, 0.001, "id").collect()}
    assert got == {(0, 0), (0, 1), (1, 1), (1, 0), (2, 2), (2, 3), (3, 3), (3, 1)}
    assert {(r.a, r.b) for r in nearest(df, df, 2, 0.5, "id", on=("g",)).where("a = 3").collect()} == {(3, 3)}


def brute_nearest(left, right, k):
    out = set()
    for a, *p, g in left:
        near = sorted((sum((u - v) ** 2 for u, v in zip(p, q)), b) for b, *q, h in right if g == h)
        out |= {(a, b, i + 1) for i, (_, b) in enumerate(near[:k])}
    return out


def test_nearest_by_levels_equals_brute_force(spark):
    import random

    from voxelith.operators.neighbors import nearest

    rng = random.Random(3)
    spot = lambda c, s: tuple(round(v + rng.gauss(0, s), 3) for v in c)
    left = [(i, *spot((0, 0, 0), 5), rng.choice("ab")) for i in range(150)] + [(i, *spot((500, -300, 40), 1), "c") for i in range(150, 200)] + [(200, 1.0, 2.0, 3.0, "none")]
    right = [(i, *spot((900, 0, 0), 8), rng.choice("ab")) for i in range(1000, 1200)] + [(i, 2.5, 2.5, 2.5, "a") for i in range(1200, 1300)] + [(1300, 0.0, 0.0, 0.0, "c"), (1301, 1e5, 0.0, 0.0, "c")]
    names = "id int, x double, y double, z double, g string"
    l, r = spark.createDataFrame(left, names), spark.createDataFrame(right, names)
    assert {(t.a, t.b, t.rank) for t in nearest(l, r, 4, 2.0, "id", on=("g",)).collect()} == brute_nearest(left, right, 4)
    flat = lambda rows: [(*t[:4], "x") for t in rows]
    assert {(t.a, t.b, t.rank) for t in nearest(l, r, 1, 2.0, "id").collect()} == brute_nearest(flat(left), flat(right), 1)
    assert nearest(l, r.where("false"), 2, 1.0, "id").collect() == [] and nearest(l.where("false"), r, 2, 1.0, "id").collect() == []


def test_distant_clusters_meet_in_few_pairs(spark):
    from voxelith.operators import neighbors

    n = 1500
    cloud = lambda at, seed: spark.range(n).selectExpr("id", f"{at} + rand({seed}) * 10 as x", f"rand({seed + 1}) * 10 as y", f"rand({seed + 2}) * 10 as z")
    left, right = cloud(0, 1).cache(), cloud(1000, 5).cache()
    pairs = neighbors._by_levels(left, right, 1, 4.0, "id", ("x", "y", "z"), (), ())
    assert pairs.count() < 0.15 * n * n and pairs.select("a").distinct().count() == n
    best = pairs.groupBy("a").agg(F.min("d2").alias("d2"))
    x = np.array(left.orderBy("id").select("x", "y", "z").collect())
    y = np.array(right.orderBy("id").select("x", "y", "z").collect())
    want = ((x[:, None] - y[None]) ** 2).sum(-1).min(1)
    assert np.allclose([r.d2 for r in best.orderBy("a").collect()], want)


def test_donors_fall_back_from_kind_to_near_to_all(spark):
    from voxelith.operators.neighbors import donor_means

    donors = [(i, float(i), 0.0, 0.0, kind, near, float(10 * i)) for i, (kind, near) in enumerate([("floor", True), ("floor", True), ("floor", True), ("wall", True), ("wall", False), ("wall", False), ("wall", False)])]
    targets = [(100, 2.6, 0.0, 0.0, "floor"), (101, 2.6, 0.0, 0.0, "wall"), (102, 2.6, 0.0, 0.0, "ceiling")]
    d = spark.createDataFrame(donors, "id int, x double, y double, z double, kind string, near boolean, red double")
    t = spark.createDataFrame(targets, "id int, x double, y double, z double, kind string")

    def want(pool, k):
        near = sorted((abs(2.6 - x), x * 10) for x in pool)[:k]
        w = [1 / max(a, 0.5) ** 2 for a, _ in near]
        return sum(v * u for (_, v), u in zip(near, w)) / sum(w)

    for k, pools in ((3, {100: [0, 1, 2], 101: [0, 1, 2, 3], 102: [0, 1, 2, 3]}), (5, dict.fromkeys((100, 101, 102), range(7)))):
        got = {r.id: r.red for r in donor_means(t, d, "id", "kind", "near", ("red",), k, 50.0, 0.5).collect()}
        assert set(got) == set(pools) and all(abs(got[i] - want(p, k)) < 1e-9 for i, p in pools.items())


def test_many_rounds_of_growing_and_shrinking(spark):
    one = spark.createDataFrame([(0, 0, 0)], "ix int, iy int, iz int")
    grown = volume.dilate(one, 9)
    assert grown.count() == sum(1 for x in range(-9, 10) for y in range(-9, 10) for z in range(-9, 10) if abs(x) + abs(y) + abs(z) <= 9)
    assert [tuple(r) for r in volume.erode(grown, 9).collect()] == [(0, 0, 0)]
    line = spark.range(-3, 6).selectExpr("cast(id as int) as ix", "0 as iy", "0 as iz")
    assert volume.dilate(one, 9, mask=line).count() == 9
