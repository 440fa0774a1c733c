"""What a step makes on the way: searches by place, tiles over all tasks."""

import pytest
from pyspark.sql import functions as F

from voxelith.operators import neighbors as N


@pytest.fixture
def pairs(monkeypatch):
    """Counts of the pairs that range joins make."""
    made, plain = [], N.range_pairs

    def counted(*a, **k):
        out = plain(*a, **k)
        made.append(out.count())
        return out

    monkeypatch.setattr(N, "range_pairs", counted)
    return made


def copies(spark, n=900):
    """n points in three places in a row."""
    return spark.range(n).select("id", *((F.col("id") % 3 if c == "x" else F.lit(0)).cast("double").alias(c) for c in "xyz"))


def test_rows_in_one_place_are_counted_as_one(spark, pairs):
    df = copies(spark)
    got = {r.id: r.neighbours for r in N.within(df, df, 1.0, "id").collect()}
    assert got == {i: 900 if i % 3 == 1 else 600 for i in range(900)} and sum(pairs) <= 9


def test_rows_in_one_place_search_once(spark, pairs):
    df = copies(spark)
    got = {}
    for r in N.nearest(df, df.where("x = 1"), 2, 1.0, "id").collect():
        got.setdefault(r.a, set()).add((r.b, r.d2, r["rank"]))
    assert got == {i: {(1, float(i % 3 != 1), 1), (4, float(i % 3 != 1), 2)} for i in range(900)} and sum(pairs) <= 9


def test_keys_in_several_places_share_one_list(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 5.0), (2, 0.5), (3, 5.1)], "id int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = sorted((r.a, r.b, r["rank"]) for r in N.nearest(df.where("id = 1"), df.where("id > 1"), 2, 1.0, "id").collect())
    assert got == [(1, 2, 2), (1, 3, 1)]


def test_a_few_frames_are_fused_by_many_tasks(spark):
    from voxelith.operators.fusion import ROTATION, Grid, cell_samples

    pose = dict.fromkeys(ROTATION, 0.0) | {"r00": 1.0, "r11": 1.0, "r22": 1.0, "tx": -4.0, "ty": -4.0, "tz": 0.0, "fx": 8.0, "fy": 8.0, "cx": 8.0, "cy": 6.0, "width": 16, "height": 12}
    frames = spark.createDataFrame([{"frame": 1} | pose]).coalesce(1)
    depths = spark.range(12 * 16).select(F.lit(1).cast("long").alias("frame"), F.floor(F.col("id") / 16).cast("int").alias("v"), (F.col("id") % 16).cast("int").alias("u"), F.lit(4.0).alias("depth"))
    seen = cell_samples(frames, F.broadcast(depths), Grid((0.0, 0.0, 0.0), 0.5, (16, 16, 16)), 6.0)
    assert seen.select(F.spark_partition_id()).distinct().count() > 1


def test_cameras_meet_what_is_in_view(spark):
    """Points in one place are one, cameras in one place are taken once; the least key of the nearest stays; sides that no camera sees meet none."""
    from voxelith.operators.frames import visible

    points = spark.createDataFrame([(i, 0, x, y, z) for i, (x, y, z) in enumerate([(5, 5, 9), (5, 5, 9), (5, 5, 20), (90, 5, 9), (5, 5, 1), (4, 6, 3)])] + [(9, 1, 5, 5, 9)], "id long, rig long, x int, y int, z int")
    cameras = spark.createDataFrame([(c, 0, 5.0, 5.0, 2.0) for c in (7, 8)] + [(1, 1, 5.0, 5.0, 30.0), (2, 0, 80.0, 5.0, 0.0)], "cam long, rig long, x double, y double, z double")
    got = visible(points, cameras, "id", "cam", "rig", (50.0, 50.0), (32.0, 24.0), (64, 48))
    # (4, 6) is beside the picture from z 2; (90, 5) is beside it too, ten across at a depth of nine
    assert sorted(map(tuple, got.collect())) == [(7, 32, 24, 0, 7.0), (8, 32, 24, 0, 7.0)]
    plan = got._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def test_visible_points_by_brute_force(spark):
    import random

    from voxelith.operators.frames import visible

    r = random.Random(3)
    points = [(i, i % 2, r.uniform(-40, 40), r.uniform(-40, 40), r.choice([r.uniform(-30, 60), 12.0])) for i in range(3000)]
    cameras = [(c, r.randrange(3), r.uniform(-20, 20), r.uniform(-20, 20), r.uniform(-20, 20)) for c in [*range(12), 2, 5]]
    want = {}
    for i, rig, x, y, z in points:
        for c, own, ox, oy, oz in cameras:
            if own == rig and z - oz > 0:
                u, v = 20.0 * (x - ox) / (z - oz) + 8.0, 25.0 * (y - oy) / (z - oz) + 6.0
                if 0 <= u < 16 and 0 <= v < 12:
                    at = (c, int(u), int(v))
                    want[at] = min(want.get(at, (1e9, 0)), (z - oz, i))
    got = visible(spark.createDataFrame(points, "id long, rig long, x double, y double, z double"), spark.createDataFrame([*cameras, cameras[0]], "cam long, rig long, x double, y double, z double"), "id", "cam", "rig", (20.0, 25.0), (8.0, 6.0), (16, 12))
    assert {(r.cam, r.u, r.v): (r.depth, r.id) for r in got.collect()} == want and len(want) > 200


def test_a_point_far_away_is_seen(spark):
    from voxelith.operators.frames import visible

    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 1e7), (2, 0, 0.0, 0.0, -1e7), (3, 0, 0.2, 0.0, 4.0)], "id long, rig long, x double, y double, z double")
    cameras = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], "cam long, rig long, x double, y double, z double")
    see = lambda p: sorted(map(tuple, visible(p, cameras, "id", "cam", "rig", (50.0, 50.0), (32.0, 24.0), (64, 48)).collect()))
    assert see(points) == [(1, 32, 24, 1, 1e7), (1, 34, 24, 3, 4.0)]
    assert see(points.limit(0)) == []


def test_whole_lattices_do_not_go_through_the_driver(spark):
    from voxelith.operators.lineage import SENT_ROWS, cut

    place = lambda n: cut(spark.range(n).select(*((F.col("id") / d % m).cast("int").alias(c) for c, d, m in (("x", 1, 200), ("y", 200, 100), ("z", 20000, 50)))))
    joined = lambda n: place(2000).join(place(n), ["x", "y", "z"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in joined(4 * SENT_ROWS)  # some hundred kB as a file
    assert "BroadcastExchange" in joined(1000)


def test_places_found_are_not_sent_to_all_tasks(spark):
    df = copies(spark)
    found = N.nearest(df, df.where("x = 1"), 2, 1.0, "id")
    found.collect()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_cells_of_frames_do_not_go_through_the_driver(spark):
    """Cells are hundreds for each tile that they come from, whose size is all that Spark knows of them."""
    from voxelith.operators.fusion import ROTATION, Grid, cell_samples
    from voxelith.operators.refine import render

    pose = dict.fromkeys(ROTATION, 0.0) | {"r00": 1.0, "r11": 1.0, "r22": 1.0, "tx": -4.0, "ty": -4.0, "tz": 0.0, "fx": 8.0, "fy": 8.0, "cx": 8.0, "cy": 6.0, "width": 16, "height": 12}
    frames = spark.createDataFrame([{"frame": 1} | pose])
    depths = spark.range(12 * 16).select(F.lit(1).cast("long").alias("frame"), F.floor(F.col("id") / 16).cast("int").alias("v"), (F.col("id") % 16).cast("int").alias("u"), F.lit(4.0).alias("depth"))
    grid = Grid((0.0, 0.0, 0.0), 0.5, (16, 16, 16))
    points = spark.range(10).select(*((F.col("id") % 5 + 1).cast("double").alias(c) for c in "xyz"))
    for df in (cell_samples(frames, depths, grid, 6.0), render(points, frames, grid, 6.0)):
        assert df.count() > 0 and "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
