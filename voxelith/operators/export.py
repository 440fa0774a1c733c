"""World export end to end: blocks on a platform, chunk trees, region files, level-wide files; and reading all of it back.

Blocks are shuffled once, by chunk; a chunk (98,304 places at most) is encoded in one call, and only its compressed tree
goes on, to the task that writes its region.  Nothing but counts and the layout comes to the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from voxelith.functions.grid import chunk, local_index
from voxelith.operators.lineage import cut
from voxelith.operators.world import compare, layout, platform
from voxelith.sources.chunks import AIR, DATA_VERSION, STATUS, encode_chunk
from voxelith.sources.level import REGIONS, level_faults, write_level
from voxelith.sources.region import read_world, write_world

PLATFORM_STATE = "minecraft:smooth_stone"
#: Blocks of a platform at most, unless told otherwise.
LARGEST_PLATFORM = 4_000_000


@dataclass
class Export:
    """A world's layout, the blocks that were written, and how much it was."""

    folder: str
    place: Row
    placed: DataFrame
    counts: Row

    @property
    def spawn(self) -> tuple[int, int, int]:
        return self.place["spawn_x"], self.place["platform_y"] + 1, self.place["spawn_z"]


def placed(blocks: DataFrame, margin: int = 8, platform_y: int = 64, state: str = PLATFORM_STATE, largest: int = LARGEST_PLATFORM) -> tuple[Row, DataFrame]:
    """The layout, and all blocks of the world: the platform's, then the model's at their places.  No blocks: an error."""
    place = layout(blocks, margin, platform_y).withColumn("platform_y", F.lit(platform_y)).first()
    if place["width"] is None:
        raise ValueError("no blocks to place")
    x1, z1 = place["platform_max_x"], place["platform_max_z"]
    if (x1 + margin + 1) * (z1 + margin + 1) > largest:
        raise ValueError(f"the platform would have more than {largest} blocks")
    moved = blocks.select(*((F.col(n) + place[f"shift_{n}"]).cast("int").alias(n) for n in ("x", "y", "z")), "state")
    return place, platform(blocks.sparkSession, -margin, x1, -margin, z1, platform_y, state).unionByName(moved)


def _encode(key: tuple, rows: pa.Table) -> pa.Table:
    cx, cz = (k.as_py() for k in key)
    states = rows["state"].combine_chunks().dictionary_encode()
    tree, counts = encode_chunk(cx, cz, rows["at"].to_numpy(), rows["y"].to_numpy(), states.indices.to_numpy(), states.dictionary.to_pylist())
    return pa.table([[cx], [cz], [counts["blocks"]], [counts["sections"]], [counts["doubled"]], [zlib.compress(tree)]], schema=_CHUNK)


_CHUNK = pa.schema([("cx", pa.int32()), ("cz", pa.int32()), ("blocks", pa.int64()), ("sections", pa.int64()), ("doubled", pa.int64()), ("data", pa.binary())])


def chunk_trees(blocks: DataFrame) -> DataFrame:
    """(cx, cz, blocks, sections, doubled, data): each chunk's compressed tree.  Air is no block; rows with a null are left out."""
    given = blocks.where((F.col("state") != AIR) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    x, y, z = (F.col(n).cast("int") for n in ("x", "y", "z"))
    keyed = given.select(chunk(x).alias("cx"), chunk(z).alias("cz"), local_index(x, y, z).alias("at"), y.alias("y"), "state")
    return keyed.groupBy("cx", "cz").applyInArrow(_encode, "cx int, cz int, blocks bigint, sections bigint, doubled bigint, data binary")


def export_world(blocks: DataFrame, folder: str, name: str = "world", now_ms: int = 0, most: int | None = None, template: dict[str, bytes] | None = None, **how) -> Export:
    """Blocks (x, y, z, state) as a save in a folder that all executors share.  Blocks on one another or on the platform,
    beyond the build limits, of states that are no full solid block, or more than `most`, are errors; then no region is written."""
    place, world = placed(blocks, **how)
    trees = cut(chunk_trees(world))
    area = (place["platform_max_x"] - place["platform_min"] + 1) * (place["platform_max_z"] - place["platform_min"] + 1)
    regions = F.count_distinct(F.shiftright("cx", 5), F.shiftright("cz", 5))
    counts = trees.agg(F.count("*").alias("chunks"), *(F.sum(c).alias(c) for c in ("blocks", "sections", "doubled")), regions.alias("regions")).first()
    if counts["doubled"]:
        raise ValueError(f"{counts['doubled']} blocks stand where others do")
    if most is not None and counts["blocks"] - area > most:
        raise ValueError(f"more than {most} blocks")
    write_world(trees, f"{folder}/{REGIONS}", now_ms // 1000)
    out = Export(folder, place, world, counts)
    write_level(folder, out.spawn, name, now_ms, template)
    return out


def read_blocks(spark, folder: str) -> DataFrame:
    return read_world(spark, f"{folder}/{REGIONS}")


def world_faults(export: Export) -> DataFrame:
    """Differences of a written world from the blocks it was written from (x, y, z, expected, actual, difference); raises
    on chunks of another version or status, and on level-wide files that break the rules."""
    spark = export.placed.sparkSession
    chunks = read_world(spark, f"{export.folder}/{REGIONS}", "chunks")
    odd = chunks.where((F.col("data_version") != DATA_VERSION) | (F.col("status") != STATUS)).limit(1).count()
    if odd or (faults := level_faults(export.folder, export.spawn)):
        raise ValueError("chunks of another version or status" if odd else f"level files: {', '.join(faults)}")
    return compare(export.placed, read_blocks(spark, export.folder).select("x", "y", "z", "state"))


def height_rows(chunks: DataFrame, name: str = "WORLD_SURFACE") -> DataFrame:
    """(x, z, height) of chunks' height maps, empty columns left out."""
    rows = chunks.select("cx", "cz", F.posexplode(F.col("heights")[name]).alias("at", "height")).where("height > 0")
    return rows.select((F.col("cx") * 16 + F.col("at").bitwiseAND(15)).alias("x"), (F.col("cz") * 16 + F.shiftright("at", 4)).alias("z"), "height")



def dump_world(spark, folder: str, target: str) -> None:
    """A save's blocks, the counts of its states (most first) and what its chunks say, as JSON lines in three folders; the
    counts, a row a state, are one ordered file."""
    blocks = read_blocks(spark, folder)
    place = F.concat_ws(",", "x", "y", "z")
    blocks.select(place.alias("place"), "state").write.json(f"{target}/blocks")
    counts = blocks.groupBy("state").agg(F.count("*").alias("blocks"))
    counts.orderBy(F.desc("blocks"), "state").coalesce(1).write.json(f"{target}/distribution")
    chunks = read_world(spark, f"{folder}/{REGIONS}", "chunks")
    chunks.select(F.concat_ws(",", "cx", "cz").alias("chunk"), "data_version", "status", "light_on", "heights").write.json(f"{target}/chunks")
