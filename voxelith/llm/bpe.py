"""Byte-level BPE encoding and decoding by DuckDB recursive queries per partition.

The distinct pieces of a chunk become token-position rows.  One recursive query joins neighbouring rows with the merge
table, contracts each piece's leftmost pair of minimum rank, and repeats until no pair of any piece is in the table.
An ordered aggregation gives the ids, and another, over the vocabulary's bytes, decodes them.

Null text counts as empty: no ids, and the hash of no bytes.  The rank file's path is a parameter; it must be readable
on every executor.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelith.llm.store import arrow_map
from voxelith.llm.textbatch import WordTable, chunks, gather, pretokens

#: Pieces of one recursive query; more are done in turn.
PER_QUERY = 20_000
#: Distinct pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 800_000

_ENCODE = """
with recursive step(w, p, t, q, u, live) as (
  select w, p, t, q, u, true from start
  union all
  (with cur as (select s.w, s.p, s.t, s.q, s.u, m.m from step s left join merges m on m.l = s.t and m.r = s.u where s.live),
        best as (select w, min(m::bigint * 4294967296 + p) as b, arg_min(q, m::bigint * 4294967296 + p) as bq from cur group by w),
        hop as (select best.w, b % 4294967296 as bp, bq, (b // 4294967296)::int as bm, d.q as nq, d.u as nu from best join cur d on d.w = best.w and d.p = bq)
   select c.w, c.p, case when c.p = h.bp then h.bm else c.t end, case when c.p = h.bp then h.nq else c.q end,
          case when c.p = h.bp then h.nu when c.q = h.bp then h.bm else c.u end, h.w is not null
   from cur c left join hop h on h.w = c.w where h.w is null or c.p <> h.bq)
)
select w, list(t order by p) as ids from step where not live group by w order by w
"""
_DECODE = "select w, string_agg(v.hex, '' order by p) as hex from ids join vocab v on v.t = ids.t group by w order by w"


@lru_cache(2)
def _engine(path: str):
    import duckdb

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), merged.append(rank)
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    for name, table in (
        ("merges", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(merged, pa.int32())})),
        ("vocab", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([k.hex() for k in ranks])})),
    ):
        con.register("given", table)
        con.execute(f"create table {name} as select * from given")
        con.unregister("given")
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return con, byte_ids


def encode_pieces(pieces: list[bytes], path: str) -> list[list[int]]:
    """Ids of each (non-empty) piece."""
    con, byte_ids = _engine(path)
    out: list[list[int]] = []
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and end - at < PER_QUERY and (size == 0 or size + len(pieces[end]) <= 16 * PER_QUERY):
            size += len(pieces[end])
            end += 1
        part = pieces[at:end]
        n = np.array([len(p) for p in part])
        w = np.repeat(np.arange(len(part), dtype=np.int32), n)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        t = byte_ids[np.frombuffer(b"".join(part), np.uint8)]
        last = p + 1 == np.repeat(n, n)  # a position's row also holds the next position and its token
        nxt = lambda x: pa.array(np.append(x[1:], 0).astype(np.int32), mask=last)
        con.register("start", pa.table({"w": w, "p": p, "t": t, "q": nxt(p), "u": nxt(t)}))
        out += [ids for _, ids in con.execute(_ENCODE).fetchall()]
        con.unregister("start")
        at = end
    return out


def decode_pieces(ids: list[list[int]], path: str) -> list[bytes]:
    """Bytes of each (non-empty) list of ids."""
    con, _ = _engine(path)
    n = np.array([len(x) for x in ids])
    w = np.repeat(np.arange(len(ids), dtype=np.int32), n)
    p = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    con.register("ids", pa.table({"w": w, "p": p, "t": np.concatenate([np.asarray(x, np.int32) for x in ids])}))
    out = [bytes.fromhex(h) for _, h in con.execute(_DECODE).fetchall()]
    con.unregister("ids")
    return out


@lru_cache(2)
def _table(path: str) -> WordTable:
    """One a worker, kept from task to task."""

    def fill(pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        ids = encode_pieces(pieces, path)
        return [(array("I", i).tobytes(), d) for i, d in zip(ids, decode_pieces(ids, path), strict=True)]

    return WordTable(fill, REMEMBERED)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` (array of int) if asked for."""
    kept = docs.select(id_col, text_col)
    schema = f"{id_col} {kept.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            counts, enc, dec, all_ids = [], [], [], []
            for _, data, offsets in chunks(batch.column(1)):
                starts, ends, rows = pretokens(data, offsets)
                codes, values = table.lookup(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), [])
                at = np.zeros(len(values) + 1, np.int64)
                np.cumsum([len(v[0]) // 4 for v in values], out=at[1:])
                ids, id_at = gather(np.frombuffer(b"".join(v[0] for v in values), np.uint32), at, codes)
                np.cumsum([len(v[1]) for v in values], out=at[1:])
                text, text_at = gather(np.frombuffer(b"".join(v[1] for v in values), np.uint8), at, codes)
                ids, text = ids.astype("<u4"), text.astype(np.uint8)
                a, b = id_at[rows], text_at[rows]
                counts += np.diff(a).tolist()
                enc += [hashlib.sha256(ids[i:j].data).hexdigest() for i, j in zip(a[:-1], a[1:], strict=True)]
                dec += [hashlib.sha256(text[i:j].data).hexdigest() for i, j in zip(b[:-1], b[1:], strict=True)]
                if with_ids:
                    all_ids += [ids[i:j].astype(np.int32) for i, j in zip(a[:-1], a[1:], strict=True)]
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(kept, run, schema)
