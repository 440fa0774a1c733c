"""World export: chunk trees, region source, level files, and what they refuse."""

import gzip
import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import export as X
from voxelith.operators.world import compare
from voxelith.sources import chunks as C
from voxelith.sources import level as L
from voxelith.sources.binary import Tag, decode_nbt, decode_region, encode_nbt, lay_out
from voxelith.sources.region import indexed, read_world, write_world
from voxelith.sources.files import names, resolve


def blocks(spark, rows):
    return spark.createDataFrame(rows, "x int, y int, z int, state string")


def column(rows, cx=0, cz=0):
    x, y, z = (np.array([r[i] for r in rows]) for i in range(3))
    states = sorted({r[3] for r in rows})
    at = ((y & 15) << 8) | ((z & 15) << 4) | (x & 15)
    return C.encode_chunk(cx, cz, at, y, np.array([states.index(r[3]) for r in rows]), states)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 300])
def test_words_hold_what_they_were_given(n):
    values = np.arange(4096) % n
    bits = C.index_bits(n)
    words = C.pack(values, bits)
    assert bits == max(4, (n - 1).bit_length()) and len(words) == -(-4096 // (64 // bits))
    assert (C.unpack(words, bits, 4096) == values).all()
    with pytest.raises(ValueError):
        C.unpack(words[:-1], bits, 4096)


def test_a_chunk_tree_and_its_heights():
    rows = [(0, 64, 0, "minecraft:a"), (0, 70, 0, "minecraft:oak_log[lit=x,axis=z]"), (3, 66, 2, "minecraft:b"), (15, -64, 15, "minecraft:a"), (5, 319, 5, "minecraft:a")]
    raw, counts = column(rows)
    assert counts == {"blocks": 5, "sections": 3, "doubled": 0}
    info, sections = C.decode_chunk(raw, 0, 0)
    got = {(int(at & 15), sy * 16 + int(at >> 8), int(at >> 4 & 15), states[k]) for sy, places, index, states in sections for at, k in zip(places, index)}
    assert got == {r if "[" not in r[3] else (*r[:3], "minecraft:oak_log[axis=z,lit=x]") for r in rows}
    top = info["heights"]["WORLD_SURFACE"]
    assert set(info["heights"]) == set(C.HEIGHT_MAPS) and (top[0], top[2 * 16 + 3], top[255], top[85], top[1]) == (135, 131, 1, 384, 0)
    with pytest.raises(ValueError):
        C.decode_chunk(raw, 1, 0)
    for bad in ([(0, 320, 0, "minecraft:a")], [(0, -65, 0, "minecraft:a")], [(0, 0, 0, "minecraft:oak_leaves")]):
        with pytest.raises(ValueError):
            column(bad)
    assert column([(0, 0, 0, "minecraft:a"), (16, 0, 0, "minecraft:b")])[1]["doubled"] == 1


def test_export_reads_back_and_is_laid_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    places = {(int(x), int(y), int(z)) for x, y, z in zip(rng.integers(-700, 900, 3000), rng.integers(0, 60, 3000), rng.integers(-40, 40, 3000))}
    model = blocks(spark, [(*p, f"minecraft:s{sum(p) % 40}") for p in sorted(places)])
    out = X.export_world(model, str(tmp_path / "w"), "Test world", 5000)
    assert X.world_faults(out).count() == 0
    back = X.read_blocks(spark, out.folder)
    low = [min(p[i] for p in places) for i in range(3)]
    wide, deep = (max(p[i] for p in places) - low[i] + 1 for i in (0, 2))
    assert back.count() == len(places) + (wide + 16) * (deep + 16) == out.counts["blocks"]
    assert back.where("y = 64").select("state").distinct().collect()[0][0] == X.PLATFORM_STATE and back.agg(F.min("x"), F.max("z")).first() == (-8, deep + 7)
    assert out.spawn == ((wide - 1) // 2, 65, -4) and out.counts["regions"] == len(names(f"{out.folder}/{L.REGIONS}", ".mca"))
    moved = model.select(*(F.col(n) - m + (65 if n == "y" else 0) for n, m in zip("xyz", low)), "state").toDF("x", "y", "z", "state")
    assert compare(moved, back.where("y > 64").select("x", "y", "z", "state")).count() == 0
    _, tree = decode_nbt((tmp_path / "w" / "level.dat").read_bytes())
    data = tree["Data"][1]
    assert data["LevelName"] == (8, "Test world") and data["spawn"][1]["pos"] == (11, list(out.spawn)) and data["LastPlayed"] == (4, 5000)
    assert (tmp_path / "w" / "level.dat_old").read_bytes() == (tmp_path / "w" / "level.dat").read_bytes()
    part = read_world(spark, f"{out.folder}/{L.REGIONS}").where("cx >= 3 and cx < 5 and z < 32")
    assert part.count() == back.where("cx in (3, 4) and z < 32").count() > 0


def test_pushed_bounds_leave_files_and_chunks_unread(spark, tmp_path):
    from voxelith.sources.region import PushingRegionReader
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    write_world(X.chunk_trees(blocks(spark, [(x, 1, z, "minecraft:a") for x in range(-600, 600, 16) for z in (0, 40)])), str(tmp_path))
    reader = lambda *f: (r := PushingRegionReader(str(tmp_path), "blocks"), list(r.pushFilters(f)))[0]
    held = lambda r: [c for p in r.partitions() for c in p.chunks]
    assert len(held(reader())) == 150
    assert {c[:2] for c in held(reader(EqualTo(("cx",), -1), LessThanOrEqual(("cz",), 0)))} == {(-1, 0)}
    assert {c[0] for c in held(reader(GreaterThan(("x",), 575)))} == {c[0] for c in held(reader()) if c[0] >= 36}
    assert {c[0] for c in held(reader(In(("cx",), (3, 5))))} == {3, 4, 5}
    assert {p.path.rsplit("/", 1)[1] for p in reader(EqualTo(("x",), -600)).partitions()} == {"r.-2.0.mca"}
    fs, at = resolve(str(tmp_path))
    assert len(indexed(fs, f"{at}/r.0.0.mca")) == len(decode_region((tmp_path / "r.0.0.mca").read_bytes()))


def test_refusals_leave_no_region(spark, tmp_path):
    one = [(0, 0, 0, "minecraft:a")]
    for i, (rows, how) in enumerate((
        ([*one, *one], {}), ([*one, (0, 300, 0, "minecraft:a")], {}), ([*one, (100, 0, 0, "minecraft:a")], {"largest": 100}), ([*one, (1, 0, 0, "minecraft:water")], {}), ([*one, (1, 0, 0, "minecraft:a")], {"most": 1}), ([], {}),
    )):
        with pytest.raises(Exception):
            X.export_world(blocks(spark, rows), str(tmp_path / str(i)), **how)
        assert not list((tmp_path / str(i)).rglob("*.mca"))
    X.export_world(blocks(spark, [*one, (5, 0, 0, C.AIR), (None, 0, 0, "minecraft:a")]), str(tmp_path / "again"))
    with pytest.raises(Exception):
        write_world(X.chunk_trees(blocks(spark, one)), str(tmp_path / "again" / L.REGIONS))
    twice = X.chunk_trees(blocks(spark, one))
    with pytest.raises(Exception):
        write_world(twice.union(twice), str(tmp_path / "twice"))
    assert not list((tmp_path / "twice").rglob("*.mca")) or not list((tmp_path / "twice").rglob("r.0.0.mca"))


def test_validation_sees_a_changed_block_and_broken_files(spark, tmp_path):
    out = X.export_world(blocks(spark, [(0, 0, 0, "minecraft:a"), (1, 0, 0, "minecraft:b")]), str(tmp_path / "w"))
    at = next((tmp_path / "w" / L.REGIONS).glob("r.0.0.mca"))
    held = {(x, z): raw for x, z, raw in decode_region(at.read_bytes())}
    assert encode_nbt(decode_nbt(held[0, 0])[1]) == held[0, 0]
    at.write_bytes(lay_out({z * 32 + x: zlib.compress(raw.replace(b"minecraft:b", b"minecraft:c")) for (x, z), raw in held.items()}))
    assert [(r.expected, r.actual, r.difference) for r in X.world_faults(out).collect()] == [("minecraft:b", "minecraft:c", "mismatch")]
    L.write_level(out.folder, (9, 9, 9), "x", 0)
    with pytest.raises(ValueError):
        X.world_faults(out)
    at.write_bytes(at.read_bytes()[:5000])
    with pytest.raises(Exception):
        X.read_blocks(spark, out.folder).count()


def test_a_captured_template_keeps_its_tags(tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name, content in L.default_template().items():
            z.writestr(name, content)
        z.writestr("dimensions/minecraft/overworld/region/x.dat", b"no")
        z.writestr("readme.md", b"no")
    got = L.capture(packed.getvalue())
    assert set(got) == {L.LEVEL, L.RULES}
    L.write_level(str(tmp_path / "w"), (1, 2, 3), "n", 7, got)
    assert L.level_faults(str(tmp_path / "w"), (1, 2, 3)) == [] and L.level_faults(str(tmp_path / "w"), (1, 2, 4)) == ["spawn"]
    with pytest.raises(ValueError):
        L.filled(gzip.compress(encode_nbt({"Data": Tag(10, {"DataVersion": Tag(3, 1)})})), None, "", 0)


@pytest.mark.parametrize("body", [
    b"\x09\x00\x01l\x03\xff\xff\xff\xfb", b"\x0b\x00\x01l\xff\xff\xff\xff", b"\x0c\x00\x01l\xff\xff\xff\xfe\x00\x00\x00\x00\x00\x00\x00\x00", b"\x09\x00\x01l\x00\x00\x00\x00\x02",
])
def test_trees_with_impossible_lengths_are_refused(body):
    with pytest.raises(ValueError):
        decode_nbt(b"\x0a\x00\x00" + body + b"\x00")


def test_a_world_is_dumped_as_json(spark, tmp_path):
    out = X.export_world(blocks(spark, [(0, 0, 0, "minecraft:a"), (1, 0, 0, "minecraft:b"), (2, 0, 0, "minecraft:b")]), str(tmp_path / "w"))
    X.dump_world(spark, out.folder, str(tmp_path / "dump"))
    states = spark.read.text(str(tmp_path / "dump" / "distribution")).collect()
    assert [r.value for r in states][1:] == ['{"state":"minecraft:b","blocks":2}', '{"state":"minecraft:a","blocks":1}'] and X.PLATFORM_STATE in states[0].value
    assert spark.read.json(str(tmp_path / "dump" / "blocks")).where("place = '2,65,0'").first().state == "minecraft:b"
    chunk = spark.read.json(str(tmp_path / "dump" / "chunks")).where("chunk = '0,0'").first()
    assert chunk.status == C.STATUS and chunk.heights.WORLD_SURFACE[0] == 65 + 1 + 64
