"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has 65,536 positions.  Every shard owns ``replicas`` virtual nodes; a row starts at the position of its id's
hash and belongs to the next node clockwise.  Capacities are the row count over the shards, one more for the first few
shards, so they sum to the row count: rows that meet a full shard continue clockwise, and at the end every shard is full
and row counts are at most one apart (the law ``rows``).

The driver only walks the counts of ring positions (65,536 at most, whatever the input); rows are ranked within salted
parts of a position, so neither a hot position nor repeated ids meet in one task.  Null ids hash like the empty
string, null text has size 8 and the checksum of no bytes.  Repeated rows are placed as often as they occur; equal rows
may swap places.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIONS = 1 << 16
REPLICAS = 128
#: Rows that one part of a ring position should have, about.
PER_PART = 5_000


def ring(shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes, clockwise; one node a position."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            at = int(hashlib.md5(f"{shard}/{replica}".encode()).hexdigest()[:4], 16)
            while at in taken:
                at = (at + 1) % POSITIONS
            taken[at] = shard
    return sorted(taken.items())


def position(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int")


def walk(counts: dict[int, int], shards: int, replicas: int = REPLICAS) -> list[tuple[int, int, int, int, int]]:
    """(position, first rank, end rank, shard, first slot): where the ranks of a position's rows go."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    nodes = ring(shards, replicas)
    places = [p for p, _ in nodes]
    out, waiting = [], []
    for at in sorted(counts):  # rows that find room at their own node
        node = bisect_left(places, at) % len(nodes)
        shard = nodes[node][1]
        n = min(counts[at], room[shard] - filled[shard])
        if n:
            out.append((at, 0, n, shard, filled[shard]))
            filled[shard] += n
        if n < counts[at]:
            waiting.append((at, n, node))
    after: dict[int, int] = {}  # full nodes point past themselves, so the walk is short

    def free(node: int) -> int:
        seen = []
        while filled[nodes[node][1]] >= room[nodes[node][1]]:
            seen.append(node)
            node = after.get(node, (node + 1) % len(nodes))
        for x in seen:
            after[x] = node
        return node

    for at, rank, node in waiting:  # the others continue clockwise
        while rank < counts[at]:
            node = free(node)
            shard = nodes[node][1]
            n = min(counts[at] - rank, room[shard] - filled[shard])
            out.append((at, rank, rank + n, shard, filled[shard]))
            filled[shard] += n
            rank += n
    return out


def shard_rows(docs: DataFrame, shards: int = 24, replicas: int = REPLICAS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    counts = {r[0]: r[1] for r in docs.groupBy(position(F.col(key)).alias("_pos")).agg(F.count("*")).collect()}  # at most POSITIONS rows
    moves = walk(counts, shards, replicas)
    table = spark.createDataFrame(
        moves, T.StructType([T.StructField(n, T.LongType() if n not in ("_pos", "shard") else T.IntegerType(), False) for n in ("_pos", "_from", "_to", "shard", "_slot")])
    )
    parts = max(1, -(-max(counts.values(), default=0) // PER_PART))
    rows = docs.select(
        F.col(key),
        (F.octet_length(t).cast("long") + 8).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        position(F.col(key)).alias("_pos"),
    )
    # the salt follows the row, not the task, so a lost executor's rows come again in the same place
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(parts)).cast("int"))
    own = rows.groupBy("_pos", "_part").agg(F.count("*").alias("_n"))
    before = own.select("_pos", "_part", (F.sum("_n").over(Window.partitionBy("_pos").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_pos", "_part").orderBy(key, "text_crc32", "size")))
    if parts > 1:
        ranked = ranked.join(before, ["_pos", "_part"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    else:
        ranked = ranked.withColumn("_rank", F.col("_in") - 1)
    # a few moves a position and at most POSITIONS positions: bounded by the ring, so it may be broadcast
    placed = ranked.join(F.broadcast(table), "_pos").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
