"""Voxel worlds of any size in the contract's format: ``write`` lays a message out over many tasks, ``read_parts`` reads it.

A message may be cut at its fields and joined again, and so may compressed frames.  Voxels are range-partitioned in canonical
order; each task encodes its run into a part of its own, a first part has versions and palette, a last one the bounds.  The
parts, one after the other in order of their names, are the message that the one-frame encoder gives.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions.grid import canonical_order
from voxelith.operators.lineage import cut
from voxelith.sources.contract import VERSION, _field, _signed
from voxelith.sources.files import names, resolve

#: Voxels a part, about.
PART_ROWS = 1 << 20
#: Palette entries that are sent to every task, at most.
LARGEST_PALETTE = 65_536
_LEVEL = 10


def voxel_fields(x: np.ndarray, y: np.ndarray, z: np.ndarray, colour: np.ndarray) -> bytes:
    """Field 4 of the message for every voxel, in order: all bytes that could be there as one table, and those that are."""
    n = len(x)
    signed = [(v.astype(np.int64) << 1) ^ (v.astype(np.int64) >> 63) for v in (x, y, z)]
    table, used = np.zeros((n, 2 + 4 * 6), np.uint8), np.zeros((n, 2 + 4 * 6), bool)
    size = np.zeros(n, np.int64)
    for i, value in enumerate((*signed, colour.astype(np.int64))):
        at = 2 + 6 * i
        there = value != 0  # zeros are not written
        table[:, at], used[:, at] = (i + 1) << 3, there
        for k in range(5):
            more = value >> 7 * (k + 1)
            table[:, at + 1 + k] = (value >> 7 * k & 127) | np.where(more > 0, 128, 0)
            used[:, at + 1 + k] = there & (value >> 7 * k > 0)
            size += used[:, at + 1 + k]
        size += there
    table[:, 0], table[:, 1] = 4 << 3 | 2, size
    used[:, :2] = True
    return table[used].tobytes()


def _frame(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL, write_checksum=True).compress(raw)


def write(voxels: DataFrame, palette: DataFrame, folder: str, game: str = "1.21", part_rows: int = PART_ROWS) -> int:
    """voxels (x, y, z, palette_id), palette (palette_id, block_state): a folder of parts that all executors share; returns
    how many voxels.  Two voxels in one place, colours that the palette lacks, and palettes with ids that are not positive or
    states that come twice are errors; then no part is kept."""
    entries = sorted((r[0], r[1]) for r in palette.select("palette_id", "block_state").limit(LARGEST_PALETTE + 1).collect())
    ids = {i for i, _ in entries}
    if len(entries) > LARGEST_PALETTE or any(i is None or i <= 0 for i in ids) or len(ids) < len(entries) or len({s for _, s in entries}) < len(entries):
        raise ValueError("palette ids must be positive and unique, states distinct")
    fs, path = resolve(folder)
    fs.create_dir(path, recursive=True)
    if names(folder, ".zst"):
        raise ValueError(f"{folder} has parts")
    run = uuid.uuid4().hex

    def encode(batches):
        out, rows, ends, last = None, 0, [], None
        name = f"{path}/{uuid.uuid4().hex}.{run}"
        packer = zstandard.ZstdCompressor(level=_LEVEL, write_checksum=True).compressobj()
        for batch in batches:
            x, y, z, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "z", "palette_id"))
            if not len(x):
                continue
            if not set(np.unique(c).tolist()) <= ids:
                raise ValueError("a voxel names a colour that the palette lacks")
            xyz = np.stack([x, y, z], 1).astype(np.int64)
            whole = xyz if last is None else np.concatenate([last, xyz])
            if (whole[1:] == whole[:-1]).all(1).any():
                raise ValueError("two voxels in one place")
            if out is None:
                out, first = fs.open_output_stream(name, compression=None), xyz[0].tolist()
            out.write(packer.compress(voxel_fields(x, y, z, c)))
            rows, last, ends = rows + len(x), xyz[-1:], [*ends, xyz.min(0), xyz.max(0)]
        if out is not None:
            out.write(packer.flush())
            out.close()
            ends = np.array(ends)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, rows, first, ends.min(0).tolist(), ends.max(0).tolist())], ["name", "n", "first", "low", "high"])

    n = voxels.count()
    ranged = voxels.select("x", "y", "z", F.col("palette_id").cast("bigint").alias("palette_id")).repartitionByRange(max(1, -(-n // part_rows)), *canonical_order()).sortWithinPartitions(*canonical_order())
    try:
        parts = cut(ranged.mapInArrow(encode, "name string, n bigint, first array<bigint>, low array<bigint>, high array<bigint>")).collect()  # a row a part
    except Exception:
        for left in names(folder, f".{run}"):
            fs.delete_file(left)
        raise
    kept = {p["name"] for p in parts}
    for left in names(folder, f".{run}"):  # of attempts that were lost
        if left not in kept:
            fs.delete_file(left)
    parts.sort(key=lambda p: tuple(v >> 4 for v in (p["first"][0], p["first"][2], p["first"][1])) + (p["first"][1], p["first"][2], p["first"][0]))
    head = _field(1, VERSION) + _field(2, game.encode()) + b"".join(_field(3, _field(1, i) + _field(2, s.encode())) for i, s in entries)
    ends = [f(p[k][a] for p in parts) for f, k in ((min, "low"), (max, "high")) for a in range(3)] if parts else []
    tail = _field(5, b"".join(_field(i + 1, _signed(int(e))) for i, e in enumerate(ends))) if parts else b""
    for i, p in enumerate(parts):
        fs.move(p["name"], f"{path}/part-{i + 1:08d}.zst")
    for name, raw in (("part-00000000.zst", head), (f"part-{len(parts) + 1:08d}.zst", tail)):
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(_frame(raw))
    return n


def joined(folder: str, target: str) -> None:
    """The parts as one file, copied in pieces."""
    fs, _ = resolve(folder)
    to, path = resolve(target)
    with to.open_output_stream(path, compression=None) as out:
        for part in names(folder, ".zst"):
            with fs.open_input_stream(part, compression=None) as f:
                while piece := f.read(1 << 20):
                    out.write(piece)


def read_parts(spark, folder: str) -> DataFrame:
    """(x, y, z, palette_id, block_state) of a folder of parts; each part is decoded by itself."""
    from voxelith.sources.contract import _fields

    def unpacked(raw: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)

    def rows(batches):
        back = lambda n: (n >> 1) ^ -(n & 1)
        for batch in batches:
            for content in batch.column("content"):
                kinds = [(k, dict(_fields(v))) for k, v in _fields(unpacked(content.as_py())) if k in (3, 4)]
                voxels = [f for k, f in kinds if k == 4]
                states = [f for k, f in kinds if k == 3]
                cols = [[back(f.get(i, 0)) for f in voxels] + [None] * len(states) for i in (1, 2, 3)]
                colour = [f.get(4, 0) for f in voxels] + [f.get(1, 0) for f in states]
                names_ = [None] * len(voxels) + [f.get(2, b"").decode() for f in states]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(colour, pa.int64()), pa.array(names_, pa.string())], ["x", "y", "z", "palette_id", "block_state"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.zst").load(folder).select("content")
    both = files.mapInArrow(rows, "x int, y int, z int, palette_id bigint, block_state string")
    palette = both.where("x is null").select("palette_id", "block_state")
    return both.where("x is not null").drop("block_state").join(palette, "palette_id", "left").select("x", "y", "z", "palette_id", "block_state")
