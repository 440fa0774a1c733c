"""Text formats: sparse models, logs, palettes, probe documents, world packages."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of the model analyser's log, with the key and type of each (fixed values).
LABELS = {"Cameras": ("cameras", "bigint"), "Images": ("images", "bigint"), "Registered images": ("registered", "bigint"), "Points": ("points", "bigint"), "Mean reprojection error": ("mean_error", "double")}


def image_poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose lines of an images file: ten fields, with digits at places 0 and 8."""
    f = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).select(f.alias("f")).where((F.size("f") == 10) & F.col("f")[0].rlike("^[0-9]+$") & F.col("f")[8].rlike("^[0-9]+$"))
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    return df.select(F.col("f")[0].cast("int").alias("image_id"), *(F.col("f")[i + 1].cast("double").alias(n) for i, n in enumerate(names)), F.col("f")[8].cast("int").alias("camera_id"), F.col("f")[9].alias("name"))


def point_errors(spark: SparkSession, path: str) -> DataFrame:
    """Id and reprojection error (eighth field) of the points of a points file."""
    f = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return df.select(F.assert_true(F.size(f) >= 8, "short line").alias("_ok"), f[0].cast("bigint").alias("point_id"), f[7].cast("double").alias("error")).drop("_ok")


def frame_times(lines: DataFrame) -> DataFrame:
    """Times named in a decoder's log, in the order of its lines."""
    return lines.select(F.regexp_extract("value", r"pts_time:\s*([0-9.]+)", 1).alias("t")).where("t <> ''").select(F.col("t").cast("double").alias("t"))


def analyser_values(lines: DataFrame) -> DataFrame:
    """One row: the known labels' numbers (thousands' commas removed) and the share of registered images."""
    text = F.regexp_replace("value", r"^[IWEF][0-9]{4,}.*?\] ", "")
    kv = lines.select(F.trim(F.split_part(text, F.lit(":"), F.lit(1))).alias("k"), F.regexp_extract(F.replace(F.split_part(text, F.lit(":"), F.lit(2)), F.lit(","), F.lit("")), r"-?[0-9]+(\.[0-9]+)?", 0).alias("v"))
    out = kv.agg(*(F.max(F.when((F.col("k") == label) & (F.col("v") != ""), F.col("v"))).cast(kind).alias(name) for label, (name, kind) in LABELS.items()))
    return out.withColumn("ratio", F.try_divide("registered", "images"))


def palette(spark: SparkSession, path: str) -> DataFrame:
    """Checked entries of a palette document, in file order; raises on what breaks its rules."""
    doc = spark.read.schema("schemaVersion int, entries array<struct<id: bigint, blockState: string, srgb: array<int>, penalty: double>>").json(path, multiLine=True)
    out = doc.select("schemaVersion", F.posexplode("entries").alias("pos", "e")).select("schemaVersion", "pos", F.col("e.id").alias("palette_id"), F.col("e.blockState").alias("block_state"), *(F.col("e.srgb")[i].alias(n) for i, n in enumerate(("pr", "pg", "pb"))), F.coalesce("e.penalty", F.lit(0.0)).alias("penalty"), F.size("e.srgb").alias("_n"))
    byte = lambda c: F.col(c).between(0, 255)
    bad = out.agg(F.count_if(~((F.col("schemaVersion") == 1) & (F.col("palette_id") > 0) & F.col("block_state").startswith("minecraft:") & byte("pr") & byte("pg") & byte("pb") & (F.col("_n") == 3) & (F.col("penalty") >= 0))).alias("bad"), F.count("*").alias("n"), F.count_distinct("palette_id").alias("ids"), F.count_distinct("block_state").alias("states")).first()
    if bad["bad"] or not bad["n"] or bad["ids"] < bad["n"] or bad["states"] < bad["n"]:
        raise ValueError("the palette breaks its rules")
    return out.drop("schemaVersion", "_n")


def probe_failures(doc: dict, longest: float, shortest: float = 1.0, codecs: tuple[str, ...] = ("h264",)) -> list[str]:
    """What is wrong with a container's probe document."""
    streams = [s for s in doc.get("streams", []) if s.get("codec_type") == "video"]
    seconds = float(doc.get("format", {}).get("duration", 0))
    return [
        n for n, bad in (
            ("CONTAINER", not {"mov", "mp4"} & set(doc.get("format", {}).get("format_name", "").split(","))), ("STREAMS", len(streams) != 1),
            ("CODEC", bool(streams) and streams[0].get("codec_name") not in codecs), ("SHORT", seconds < shortest), ("LONG", seconds > longest),
        ) if bad
    ]


def upright_size(stream: dict) -> tuple[int, int]:
    """Width and height as shown: swapped for a quarter turn."""
    turn = abs(int(float(next((d["rotation"] for d in stream.get("side_data_list", []) if "rotation" in d), 0)))) % 180
    return (stream["height"], stream["width"]) if turn == 90 else (stream["width"], stream["height"])


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def settings_hash(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def sign(value: dict, secret: bytes) -> str:
    return hmac.new(secret, canonical_json(value), hashlib.sha256).hexdigest()


def check_signed(value: dict, signature: str, secret: bytes, keys: set[str], version: int = 1) -> None:
    if set(value) != keys or value.get("schemaVersion") != version:
        raise ValueError("the manifest has other keys or another version")
    if not hmac.compare_digest(sign(value, secret), signature):
        raise ValueError("the manifest's signature is wrong")


def write_json(path: str, value) -> None:
    """Readers see the old document or the new one."""
    with open(f"{path}.tmp", "wb") as f:
        f.write(canonical_json(value))
    os.replace(f"{path}.tmp", path)


def package(root: str, out: str) -> None:
    """Zip a world's files in sorted order; the archive appears when it is whole."""
    root = os.path.realpath(root)
    if os.path.realpath(out).startswith(root + os.sep):
        raise ValueError("the archive may not lie in the world")
    files = sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names)
    with zipfile.ZipFile(f"{out}.tmp", "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            if not os.path.realpath(f).startswith(root + os.sep):
                raise ValueError("a file leads out of the world")
            z.write(f, os.path.relpath(f, os.path.dirname(root)))
    os.replace(f"{out}.tmp", out)


def world_json(blocks: DataFrame) -> DataFrame:
    """Voxel rows as camel-case JSON documents, one a row."""
    return blocks.select(F.to_json(F.struct("x", "y", "z", F.col("palette_id").alias("paletteId"), F.col("block_state").alias("blockState"))).alias("value"))
