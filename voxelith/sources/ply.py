"""PLY point clouds as a data source: ``spark.read.format("ply").load(path)``, ``df.write.format("ply").save(path)``.

ASCII and little-endian binary vertices, with any scalar properties; the header gives the schema.  Big-endian files, list
properties of vertices, unknown types, missing x, y or z and short files are errors.  Binary files are read in ranges of
rows, so one large file is many tasks.  A path may be a file or a folder of files with one layout.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

# The format's type names, with numpy's codes; unsigned types widen.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
_SPARK = {"i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "f4": FloatType(), "f8": DoubleType()}
_WRITE = {"tinyint": ("char", "i1"), "smallint": ("short", "i2"), "int": ("int", "i4"), "bigint": ("uint", "u4"), "float": ("float", "f4"), "double": ("double", "f8")}
ROWS = 1 << 20


@dataclass
class Header:
    binary: bool
    count: int
    fields: list[tuple[str, str]]
    size: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, f"<{t}") for n, t in self.fields])


def header(path: str, most_lines: int = 10_000) -> Header:
    """Raises ValueError for what is not a readable point cloud."""
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        form, count, fields, inside = None, None, [], None
        for _ in range(most_lines):
            line = f.readline()
            if not line:
                break
            word = line.decode("ascii", "replace").split()
            if not word or word[0] in ("comment", "obj_info"):
                continue
            if word[0] == "format":
                form = word[1]
            elif word[0] == "element":
                inside = word[1]
                if inside == "vertex":
                    count = int(word[2])
                elif count is None:
                    raise ValueError(f"{path}: vertices must come first")
            elif word[0] == "property" and inside == "vertex":
                if word[1] == "list":
                    raise ValueError(f"{path}: list property {word[-1]}")
                if word[1] not in TYPES:
                    raise ValueError(f"{path}: unknown type {word[1]}")
                fields.append((word[2], TYPES[word[1]]))
            elif word[0] == "end_header":
                if form not in ("ascii", "binary_little_endian"):
                    raise ValueError(f"{path}: format {form}")
                if count is None or not {"x", "y", "z"} <= {n for n, _ in fields}:
                    raise ValueError(f"{path}: vertices need x, y and z")
                return Header(form != "ascii", count, fields, f.tell())
    raise ValueError(f"{path}: header without end")


def vertex_count(path: str) -> int:
    """From the header alone."""
    return header(path).count


def _files(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.ply"))) if os.path.isdir(path) else [path]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int

    def __init__(self, path: str, first: int, rows: int):
        super().__init__(None)
        self.path, self.first, self.rows = path, first, rows


class PlyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out = []
        for path in _files(self.path):
            h = header(path)
            step = ROWS if h.binary else max(1, h.count)
            out += [Range(path, at, min(step, h.count - at)) for at in range(0, h.count, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.rows:
            return
        h = header(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(h.size + (partition.first * h.dtype.itemsize if h.binary else 0))
            if h.binary:
                raw = f.read(partition.rows * h.dtype.itemsize)
                if len(raw) < partition.rows * h.dtype.itemsize:
                    raise ValueError(f"{partition.path}: short file")
                rows = np.frombuffer(raw, h.dtype)
            else:
                lines = [line.split() for line, _ in zip(f, range(partition.rows), strict=False)]
                if len(lines) < partition.rows or any(len(x) < len(h.fields) for x in lines):
                    raise ValueError(f"{partition.path}: short file")
                rows = np.zeros(len(lines), h.dtype)
                for i, (n, t) in enumerate(h.fields):
                    rows[n] = np.array([x[i] for x in lines]).astype(np.float64 if t[0] == "f" else np.int64)
        wider = {"u1": np.int16, "u2": np.int32, "u4": np.int64}
        yield pa.RecordBatch.from_arrays([pa.array(rows[n].astype(wider.get(t, f"<{t}"))) for n, t in h.fields], [n for n, _ in h.fields])


class PlyWriter(DataSourceArrowWriter):
    """One file a task, so that tasks do not wait for one another; coalesce(1) gives a single file."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema = path, schema
        if os.path.isdir(path) and os.listdir(path) and not overwrite:
            raise ValueError(f"{path} exists")
        os.makedirs(path, exist_ok=True)
        if overwrite:
            for f in _files(path):
                os.remove(f)

    def write(self, iterator) -> WriterCommitMessage:
        kinds = [_WRITE[f.dataType.simpleString()] for f in self.schema]
        dtype = np.dtype([(f.name, f"<{k[1]}") for f, k in zip(self.schema, kinds, strict=True)])
        parts = []
        for batch in iterator:
            rows = np.zeros(batch.num_rows, dtype)
            for i, f in enumerate(self.schema):
                rows[f.name] = batch.column(i).to_numpy(zero_copy_only=False)
            parts.append(rows.tobytes())
        n = sum(map(len, parts)) // dtype.itemsize
        if n:
            head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {k[0]} {f.name}" for f, k in zip(self.schema, kinds, strict=True)), "end_header", ""])
            at = os.path.join(self.path, f"part-{uuid.uuid4().hex}.ply")
            with open(f"{at}.tmp", "wb") as out:
                out.write(head.encode())
                out.writelines(parts)
            os.rename(f"{at}.tmp", at)
        return WriterCommitMessage()


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        return StructType([StructField(n, _SPARK[t]) for n, t in header(_files(self.options["path"])[0]).fields])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema, overwrite)
