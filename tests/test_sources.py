"""Readers and writers: round trips, and what they refuse."""

import gzip
import json
import os
import struct

import numpy as np
import pandas as pd
import pytest

from voxelith.sources import binary, contract, text
from voxelith.sources.ply import PlySource, header, vertex_count


@pytest.fixture(scope="module")
def ply(spark):
    spark.dataSource.register(PlySource)
    return spark


def test_ply_round_trip_and_ascii(ply, tmp_path):
    rows = [(i / 8, -i / 4, 0.5, i % 256, i * 3, float(i) / 100) for i in range(1000)]
    df = ply.createDataFrame(rows, "x float, y float, z float, red smallint, source bigint, confidence float")
    df.write.format("ply").mode("append").save(str(tmp_path / "out"))
    back = ply.read.format("ply").load(str(tmp_path / "out"))
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(Exception):
        df.write.format("ply").mode("append").save(str(tmp_path / "out"))
    at = tmp_path / "a.ply"
    at.write_text("ply\nformat ascii 1.0\ncomment x\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n1 2 3 255\n-1 0.5 0 7\n")
    assert [tuple(r) for r in ply.read.format("ply").load(str(at)).collect()] == [(1, 2, 3, 255), (-1, 0.5, 0, 7)] and vertex_count(str(at)) == 2


@pytest.mark.parametrize("body", [
    "ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n",
    "ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int i\nproperty float x\nproperty float y\nproperty float z\nend_header\n",
    "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty half x\nend_header\n", "obj\n", "ply\nformat ascii 1.0\n",
])
def test_ply_refusals(tmp_path, body):
    at = tmp_path / "bad.ply"
    at.write_text(body)
    with pytest.raises(ValueError):
        header(str(at))


def test_arrays_and_grey_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (3, 4, 3)):
        a = rng.random(shape).astype(np.float32)
        assert (binary.decode_array(binary.encode_array(a)) == a).all()
    a[0, 0] = 0
    (tmp_path / "d.bin").write_bytes(binary.encode_array(np.array([[0, 1.5], [2, 3]])))
    got = binary.depth_pixels(spark, str(tmp_path)).orderBy("v", "u").collect()
    assert [(r.v, r.u, r.depth) for r in got] == [(0, 0, None), (0, 1, 1.5), (1, 0, 2.0), (1, 1, 3.0)]
    for bad in (b"2&2&1&abc", b"nothing"):
        with pytest.raises(ValueError):
            binary.decode_array(bad)
    pix = rng.integers(0, 256, (17, 23), dtype=np.uint8)
    for head in (b"P5\n# c\n23 17\n255\n", b"P5\r\n23 17\r\n255\r\n"):
        assert (binary.decode_pgm(head + pix.tobytes()) == pix).all()
    for bad in (b"P5\n23 17\n255\n", b"P2\n1 1\n255\n0", b"P5\n1 1\n65535\n00", b"P5\n"):
        with pytest.raises(ValueError):
            binary.decode_pgm(bad)
    (tmp_path / "i.pgm").write_bytes(b"P5\n23 17\n255\n" + pix.tobytes())
    assert binary.grey_pixels(spark, str(tmp_path)).groupBy().sum("grey").first()[0] == int(pix.sum())


def test_sparse_model(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 3, 1, 640, 480, 500, 501, 320, 240))
    obs = struct.pack("<ddq", 1.5, 2.5, 9) + struct.pack("<ddq", 0, 0, -1)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<i7di", 1, 1, 0, 0, 0, 1, 2, 3, 3) + b"a.jpg\0" + struct.pack("<Q", 2) + obs)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 9, 1, 2, 3, 10, 20, 30, 0.5, 1) + struct.pack("<ii", 1, 0))
    cams, images, points = binary.sparse_model(spark, str(tmp_path))
    assert cams.first().fy == 501 and points.first().error == 0.5 and images.join(cams, "camera_id").first().points == [9, -1]
    with pytest.raises(ValueError):
        binary.decode_cameras(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 3, 2, 1, 1, 1, 1, 1, 1))


def test_trees_and_regions(spark, tmp_path):
    T = binary.Tag
    tree = {"b": T(1, -5), "s": T(2, 300), "i": T(3, -70000), "l": T(4, 1 << 40), "f": T(5, 0.5), "d": T(6, 0.1), "a": T(7, [1, -1]), "t": T(8, "häuser"), "list": T(9, (10, [{"x": T(3, 1)}, {}])), "ia": T(11, [5, 6]), "la": T(12, [1 << 50]), "e": T(9, (0, []))}
    raw = binary.encode_nbt(tree, "root")
    assert binary.decode_nbt(raw) == ("root", tree) and binary.decode_nbt(gzip.compress(raw)) == ("root", tree)
    deep = b"\x0a\0\0" + b"\x0a\0\x01x" * 600 + b"\0" * 601
    for bad in (raw + b"x", raw[:-4], b"\x01", deep):
        with pytest.raises(ValueError):
            binary.decode_nbt(bad)
    chunks = {(0, 0): b"one", (31, 31): os.urandom(9000), (5, 2): b""}
    packed = binary.encode_region(chunks)
    assert len(packed) % 4096 == 0 and {(x, z): d for x, z, d in binary.decode_region(packed)} == chunks
    at = int.from_bytes(packed[:3], "big") * 4096
    with pytest.raises(ValueError):
        binary.decode_region(packed[: at + 4] + b"\x01" + packed[at + 5 :])
    from voxelith.sources.region import write_world

    df = spark.createDataFrame([(0, 0, b"a"), (33, -1, b"b"), (34, -1, b"c")], "cx int, cz int, data binary")
    write_world(df, str(tmp_path / "region"))
    index = np.frombuffer((tmp_path / "region" / "r.1.-1.mca").read_bytes()[:4096], ">u4")
    assert sorted(np.flatnonzero(index).tolist()) == [31 * 32 + 1, 31 * 32 + 2] and (tmp_path / "region" / "r.0.0.mca").exists()


def test_voxel_contract(spark, tmp_path):
    v = pd.DataFrame([(0, 0, 0, 1), (-1, 0, 0, 2), (0, 17, 0, 1), (0, -1, 0, 2)], columns=["x", "y", "z", "palette_id"])
    palette = {2: "minecraft:stone", 1: "minecraft:dirt"}
    raw = contract.encode(v, palette)
    out, pal, game = contract.decode(raw)
    assert out[["x", "y", "z"]].values.tolist() == [[-1, 0, 0], [0, -1, 0], [0, 0, 0], [0, 17, 0]] and pal == palette and game == "1.21"
    assert raw == contract.encode(v.sample(frac=1, random_state=1), palette)
    (tmp_path / "w.pb.zst").write_bytes(raw)
    assert contract.read(spark, str(tmp_path)).count() == 4
    for frame, names in ((pd.concat([v, v[:1]]), palette), (v, {1: "a"}), (v, {0: "a", 1: "b", 2: "c"}), (v, {1: "a", 2: "a"})):
        with pytest.raises(ValueError):
            contract.encode(frame, names)
    for bad in (b"junk", raw[:-3], contract.zstandard.compress(contract._field(1, 9))):
        with pytest.raises(ValueError):
            contract.decode(bad)


def test_preview():
    raw = binary.encode_glb(np.array([[0, 1, 2], [3, 4, 5.5]]), np.array([[1, 2, 3], [4, 5, 6]]))
    magic, version, size = struct.unpack_from("<III", raw)
    n = struct.unpack_from("<I", raw, 12)[0]
    doc = json.loads(raw[20 : 20 + n])
    assert (magic, version, size) == (0x46546C67, 2, len(raw)) and doc["accessors"][0]["max"] == [3, 4, 5.5] and len(raw) % 4 == 0
    with pytest.raises(ValueError):
        binary.encode_glb(np.array([[np.nan, 0, 0]]), np.zeros((1, 3)))


def test_text_formats(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# c\n1 1 0 0 0 0.5 1 2 7 a.jpg\n1.5 2.5 9 3 4 -1\n2 1 0 0 0 3 1 2 7 b.jpg\n\n")
    assert [r.name for r in text.image_poses(spark, str(tmp_path / "images.txt")).collect()] == ["a.jpg", "b.jpg"]
    (tmp_path / "points3D.txt").write_text("# c\n9 1 2 3 0 0 0 0.25 1 0\n8 1 2 3 0 0 0 0.75 1 0\n")
    assert text.point_errors(spark, str(tmp_path / "points3D.txt")).selectExpr("median(error) m").first().m == 0.5
    log = spark.createDataFrame([("I20240101 12:00:00.1 1 model.cc:3] Registered images: 1,239",), ("Images: 1250",), ("Mean reprojection error: 0.87px",), ("frame pts_time: 0.125 x",), ("other",)], "value string")
    row = text.analyser_values(log).first()
    assert (row.registered, row.images, row.mean_error, row.cameras) == (1239, 1250, 0.87, None) and abs(row.ratio - 0.9912) < 1e-9
    assert [r.t for r in text.frame_times(log).collect()] == [0.125]
    good = {"schemaVersion": 1, "entries": [{"id": 1, "blockState": "minecraft:a", "srgb": [1, 2, 3]}, {"id": 2, "blockState": "minecraft:b", "srgb": [0, 0, 255], "penalty": 0.5}]}
    (tmp_path / "p.json").write_text(json.dumps(good))
    assert [tuple(r) for r in text.palette(spark, str(tmp_path / "p.json")).orderBy("pos").collect()][1] == (1, 2, "minecraft:b", 0, 0, 255, 0.5)
    good["entries"][1]["id"] = 1
    (tmp_path / "q.json").write_text(json.dumps(good))
    with pytest.raises(ValueError):
        text.palette(spark, str(tmp_path / "q.json"))


def test_documents_signatures_and_packages(tmp_path):
    probe = {"streams": [{"codec_type": "video", "codec_name": "h264", "width": 10, "height": 20, "side_data_list": [{"rotation": -90}]}], "format": {"format_name": "mov,mp4", "duration": "9.5"}}
    assert text.probe_failures(probe, 60) == [] and text.probe_failures(probe, 5) == ["LONG"] and text.upright_size(probe["streams"][0]) == (20, 10)
    job = {"schemaVersion": 1, "jobId": "a"}
    text.check_signed(job, text.sign(job, b"k"), b"k", {"schemaVersion", "jobId"})
    for value, keys in (({**job, "jobId": "b"}, set(job)), (job, {"jobId"}), ({**job, "schemaVersion": 2}, set(job))):
        with pytest.raises(ValueError):
            text.check_signed(value, text.sign(job, b"k"), b"k", keys)
    assert text.settings_hash({"a": 1, "b": 2}) == text.settings_hash({"b": 2, "a": 1})
    world = tmp_path / "world" / "region"
    world.mkdir(parents=True)
    (world / "r.0.0.mca").write_bytes(b"x")
    text.write_json(str(tmp_path / "world" / "m.json"), job)
    text.package(str(tmp_path / "world"), str(tmp_path / "world.zip"))
    import zipfile

    assert zipfile.ZipFile(tmp_path / "world.zip").namelist() == ["world/m.json", "world/region/r.0.0.mca"]
    with pytest.raises(ValueError):
        text.package(str(tmp_path / "world"), str(tmp_path / "world" / "in.zip"))
