"""Voxel worlds on disk: a Zstandard-compressed message of palette, voxels in canonical order and inclusive bounds.

The wire format is the public protobuf encoding: fields 1 schema version, 2 game version, 3 palette entries (1 id,
2 state), 4 voxels (1-3 signed coordinates, 4 palette id), 5 bounds (1-6 signed).  Encoding is deterministic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

from voxelith.sources.binary import decoded

VERSION = 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _signed(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _field(number: int, value) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value) if value else b""


def _fields(raw: bytes):
    at = 0
    while at < len(raw):
        key, at = _read_varint(raw, at)
        if key & 7 == 0:
            value, at = _read_varint(raw, at)
        elif key & 7 == 2:
            n, at = _read_varint(raw, at)
            value, at = raw[at : at + n], at + n
            if len(value) < n:
                raise ValueError("message cut off")
        else:
            raise ValueError(f"wire type {key & 7}")
        yield key >> 3, value


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(raw):
            raise ValueError("message cut off")
        out |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return out, at


def order_key(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Row order of canonical placement."""
    return np.lexsort((x, z, y, y >> 4, z >> 4, x >> 4))


def encode(voxels: pd.DataFrame, palette: dict[int, str], game: str = "1.21") -> bytes:
    """voxels: x, y, z, palette_id."""
    if any(i <= 0 for i in palette) or len(set(palette.values())) < len(palette):
        raise ValueError("palette ids must be positive and states distinct")
    if not set(voxels.palette_id) <= set(palette):
        raise ValueError("a voxel names a colour that the palette lacks")
    if voxels.duplicated(["x", "y", "z"]).any():
        raise ValueError("two voxels in one place")
    cols = [voxels[c].to_numpy(np.int64) for c in ("x", "y", "z", "palette_id")]
    order = order_key(*cols[:3])
    out = [_field(1, VERSION), _field(2, game.encode())]
    out += [_field(3, _field(1, i) + _field(2, palette[i].encode())) for i in sorted(palette)]
    for x, y, z, p in zip(*(c[order].tolist() for c in cols), strict=True):
        out.append(_field(4, _field(1, _signed(x)) + _field(2, _signed(y)) + _field(3, _signed(z)) + _field(4, p)))
    if len(voxels):
        ends = [f(c) for f in (np.min, np.max) for c in cols[:3]]
        out.append(_field(5, b"".join(_field(i + 1, _signed(int(e))) for i, e in enumerate(ends))))
    return zstandard.ZstdCompressor(level=10, write_checksum=True).compress(b"".join(out))


def decode(raw: bytes) -> tuple[pd.DataFrame, dict[int, str], str]:
    """Voxels, palette, game version; raises ValueError for what breaks the contract."""
    try:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    except zstandard.ZstdError as e:
        raise ValueError("not a compressed message") from e
    back = lambda n: (n >> 1) ^ -(n & 1)
    version, game, palette, rows, bounds = 0, None, {}, [], None
    for number, value in _fields(raw):
        if number == 1:
            version = value
        elif number == 2:
            game = value.decode()
        elif number == 3:
            f = dict(_fields(value))
            state = f.get(2, b"").decode()
            if f.get(1, 0) <= 0 or f[1] in palette or not state.strip():
                raise ValueError("palette ids must be positive and unique, states not blank")
            palette[f[1]] = state
        elif number == 4:
            f = dict(_fields(value))
            rows.append((back(f.get(1, 0)), back(f.get(2, 0)), back(f.get(3, 0)), f.get(4, 0)))
        elif number == 5:
            f = dict(_fields(value))
            bounds = [back(f.get(i, 0)) for i in range(1, 7)]
    if version != VERSION or not game:
        raise ValueError("unknown version")
    out = pd.DataFrame(rows, columns=["x", "y", "z", "palette_id"]).astype({"x": "int32", "y": "int32", "z": "int32", "palette_id": "int64"})
    if not set(out.palette_id) <= set(palette):
        raise ValueError("a voxel names a colour that the palette lacks")
    xyz = [out[c].to_numpy(np.int64) for c in "xyz"]
    if (order_key(*xyz) != np.arange(len(out))).any() or out.duplicated(["x", "y", "z"]).any():
        raise ValueError("voxels are not in canonical order")
    if len(out) and bounds != [int(f(c)) for f in (np.min, np.max) for c in xyz]:
        raise ValueError("bounds do not hold the voxels")
    return out, palette, game


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, palette_id, block_state) of every world under a path."""

    def rows(_: str, content: bytes) -> pd.DataFrame:
        out, palette, _game = decode(content)
        return out.assign(block_state=out.palette_id.map(palette))

    return decoded(spark, path, rows, "x int, y int, z int, palette_id bigint, block_state string", "*.zst")
