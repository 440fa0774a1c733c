"""Block worlds in region files as a data source: ``spark.read.format("region").load(folder)`` gives blocks (cx, cz, x, y,
z, state), with option ``what`` = ``chunks`` what chunks say of themselves, and ``df.write.format("region")`` writes chunks.

Reading: the driver looks at each file's index (4 KiB) only; tasks get runs of chunks of about TASK_SECTORS sectors, read
just those and decode one chunk at a time.  Bounds of cx, cz, x and z are pushed down: whole regions are left out by
their names, chunks by their slots.  Air is left out.  Other compressions than zlib, chunks longer than their sectors or at the wrong place are errors.

Writing: rows (rx, rz, cx, cz, data: the compressed tree), the chunks of a region together in one task, as `by_region`
deals and orders them.  A task writes whole files under a name of its own; they get their names when all tasks are done.
A region that two tasks have, or a chunk that comes twice, is an error.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxelith.sources.binary import SECTOR, ZLIB, lay_out
from voxelith.sources.chunks import decode_chunk
from voxelith.sources.files import names, resolve

BLOCKS = "cx int, cz int, x int, y int, z int, state string"
CHUNKS = "cx int, cz int, data_version int, status string, light_on int, sections int, blocks int, heights map<string,array<int>>"
#: Sectors that a task reads.
TASK_SECTORS = 4096
_NAME = re.compile(r"r\.(-?\d+)\.(-?\d+)\.mca$")
_FAR = 1 << 30


@dataclass
class Bounds:
    """Inclusive bounds of chunk numbers."""

    x0: int = -_FAR
    x1: int = _FAR
    z0: int = -_FAR
    z1: int = _FAR

    def narrow(self, name: str, low: int | None, high: int | None) -> None:
        axis = name[-1]
        if name in ("x", "z"):
            low, high = (None if b is None else b >> 4 for b in (low, high))
        if low is not None:
            setattr(self, f"{axis}0", max(getattr(self, f"{axis}0"), low))
        if high is not None:
            setattr(self, f"{axis}1", min(getattr(self, f"{axis}1"), high))

    def meets(self, x0: int, x1: int, z0: int, z1: int) -> bool:
        return x1 >= self.x0 and x0 <= self.x1 and z1 >= self.z0 and z0 <= self.z1


class Slots(InputPartition):
    def __init__(self, path: str, chunks: list[tuple[int, int, int, int]]):
        super().__init__(None)
        self.path, self.chunks = path, chunks


def indexed(fs: pyarrow.fs.FileSystem, path: str) -> list[tuple[int, int, int, int]]:
    """(cx, cz, first sector, sectors) of a region file's chunks, in order of their sectors; the bodies are not read."""
    rx, rz = map(int, _NAME.search(path).groups())
    with fs.open_input_file(path) as f:
        raw, size = f.read(SECTOR), f.size()
    if len(raw) < SECTOR:
        raise ValueError(f"{path}: short index")
    index = np.frombuffer(raw, ">u4").astype(np.int64)
    slots = np.flatnonzero(index >> 8)
    first, many = index[slots] >> 8, index[slots] & 0xFF
    if (first * SECTOR + 5 > size).any() or (first < 2).any():
        raise ValueError(f"{path}: chunk beyond the file")
    order = np.argsort(first)
    return list(zip((rx * 32 + (slots & 31))[order].tolist(), (rz * 32 + (slots >> 5))[order].tolist(), first[order].tolist(), many[order].tolist(), strict=True))


class RegionReader(DataSourceReader):
    def __init__(self, uri: str, what: str):
        self.uri, self.what, self.bounds = uri, what, Bounds()

    def partitions(self):
        fs, _ = resolve(self.uri)
        out: list[InputPartition] = []
        for path in names(self.uri, ".mca"):
            if not (m := _NAME.search(path)):
                continue
            rx, rz = int(m[1]) * 32, int(m[2]) * 32
            if not self.bounds.meets(rx, rx + 31, rz, rz + 31):
                continue
            run, sectors = [], 0
            for chunk in indexed(fs, path):
                if not self.bounds.meets(chunk[0], chunk[0], chunk[1], chunk[1]):
                    continue
                run.append(chunk)
                sectors += chunk[3]
                if sectors >= TASK_SECTORS:
                    out.append(Slots(path, run))
                    run, sectors = [], 0
            if run:
                out.append(Slots(path, run))
        return out or [Slots("", [])]

    def read(self, partition):
        if not partition.chunks:
            return
        fs, _ = resolve(self.uri)
        with fs.open_input_file(partition.path) as f:
            for cx, cz, first, many in partition.chunks:
                f.seek(first * SECTOR)
                raw = f.read(many * SECTOR)
                length = int.from_bytes(raw[:4], "big")
                if not 1 <= length <= len(raw) - 4 or raw[4] != ZLIB:
                    raise ValueError(f"{partition.path}: chunk {cx}, {cz} of length {length}, compression {raw[4]}")
                info, sections = decode_chunk(zlib.decompress(raw[5 : 4 + length]), cx, cz)
                yield self._info(cx, cz, info, sections) if self.what == "chunks" else self._blocks(cx, cz, sections)

    @staticmethod
    def _info(cx, cz, info, sections) -> pa.RecordBatch:
        values = [cx, cz, info["data_version"], info["status"], info["light_on"], len(sections), sum(len(s[1]) for s in sections)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        heights = pa.array([[(k, v.tolist()) for k, v in sorted(info["heights"].items())]], pa.map_(pa.string(), pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(values, kinds, strict=True)), heights], [c.split()[0] for c in CHUNKS.split(", ")])

    @staticmethod
    def _blocks(cx, cz, sections) -> pa.RecordBatch:
        of = lambda f: np.concatenate([f(*s) for s in sections]).astype(np.int32) if sections else np.zeros(0, np.int32)
        at, y = of(lambda _, at, *__: at), of(lambda sy, at, *_: sy * 16 + (at >> 8))
        states: dict[str, int] = {}
        for *_, own in sections:
            for s in own:
                states.setdefault(s, len(states))
        codes = of(lambda _, __, index, own: np.array([states[s] for s in own])[index])
        text = pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(list(states), pa.string())).cast(pa.string())
        n = len(at)
        whole = [np.full(n, cx, np.int32), np.full(n, cz, np.int32), cx * 16 + (at & 15), y, cz * 16 + (at >> 4 & 15)]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in whole), text], [c.split()[0] for c in BLOCKS.split(", ")])


class PushingRegionReader(RegionReader):
    """Also takes filters; Spark asks for them only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else ""
            if name in ("cx", "cz", "x", "z"):
                if isinstance(f, EqualTo):
                    self.bounds.narrow(name, f.value, f.value)
                elif isinstance(f, In) and f.value:
                    self.bounds.narrow(name, min(f.value), max(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.bounds.narrow(name, f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.bounds.narrow(name, None, f.value - isinstance(f, LessThan))
            yield f  # bounds are of whole chunks: Spark looks at the rows again


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RegionWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool, stamp: int):
        self.uri, self.stamp = uri, stamp
        fs, path = resolve(uri)
        if names(uri, ".mca") and not overwrite:
            raise ValueError(f"{uri} has regions")
        fs.create_dir(path, recursive=True)
        self.old = names(uri, ".mca") if overwrite else []

    def write(self, iterator) -> Written:
        fs, path = resolve(self.uri)
        files, region, held = [], None, {}

        def close() -> None:
            if region is None:
                return
            at = f"{path}/r.{region[0]}.{region[1]}.mca"
            part = f"{at}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as f:
                f.write(lay_out(held, self.stamp))
            files.append((part, at))

        for batch in iterator:
            rows = zip(*(batch.column(n).to_pylist() for n in ("rx", "rz", "cx", "cz")), batch.column("data"), strict=True)
            for rx, rz, cx, cz, data in rows:
                if (rx, rz) != region:
                    close()
                    region, held = (rx, rz), {}
                slot = (cx & 31) + (cz & 31) * 32
                if slot in held:
                    raise ValueError(f"chunk {cx}, {cz} comes twice")
                held[slot] = data.as_py()
        close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, _ = resolve(self.uri)
        files = [f for m in messages if m for f in m.files]
        if len({at for _, at in files}) < len(files):
            self.abort(messages)
            raise ValueError("a region came in two tasks")
        for at in self.old:
            fs.delete_file(at)
        for part, at in files:
            fs.move(part, at)

    def abort(self, messages) -> None:
        fs, _ = resolve(self.uri)
        for part, _ in [f for m in messages if m for f in m.files]:
            fs.delete_file(part)


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "region"

    def schema(self) -> str:
        return CHUNKS if self.options.get("what") == "chunks" else BLOCKS

    def reader(self, schema) -> RegionReader:
        kind = PushingRegionReader if self.options.get("pushdown") == "true" else RegionReader
        return kind(self.options["path"], self.options.get("what", "blocks"))

    def writer(self, schema, overwrite: bool) -> RegionWriter:
        return RegionWriter(self.options["path"], overwrite, int(self.options.get("stamp", "0")))


def by_region(chunks: DataFrame) -> DataFrame:
    """Chunks (cx, cz, data) as the writer takes them: a region (at most 1,024 chunks) is in one task."""
    from pyspark.sql import functions as F

    keyed = chunks.select(F.shiftright("cx", 5).alias("rx"), F.shiftright("cz", 5).alias("rz"), "cx", "cz", "data")
    return keyed.repartition("rx", "rz").sortWithinPartitions("rx", "rz")


def read_world(spark: SparkSession, folder: str, what: str = "blocks") -> DataFrame:
    """Blocks or chunks of a folder of region files, with filters pushed down."""
    spark.dataSource.register(RegionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("region").option("what", what).option("pushdown", "true").load(folder)


def write_world(chunks: DataFrame, folder: str, stamp: int = 0) -> None:
    chunks.sparkSession.dataSource.register(RegionSource)
    by_region(chunks).write.format("region").option("stamp", str(stamp)).mode("append").save(folder)
