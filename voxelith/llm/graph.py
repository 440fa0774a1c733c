"""Connected components and joins whose small side is broadcast only behind a check of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.store import drop, stored, stored_bytes

#: Rows and stored bytes (compressed) that may be broadcast, a few tens of MB in memory; larger tables are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 6 << 20


def sized(small: DataFrame) -> DataFrame:
    """small, a stored table, with a broadcast hint if its rows and bytes are few enough."""
    few = small.count() <= BROADCAST_ROWS and stored_bytes(small) <= BROADCAST_BYTES
    return F.broadcast(small) if few else small


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges (a, b), the component being its smallest id.

    Least labels travel along edges, and each round follows labels to their own labels, so rounds follow the logarithm
    of the longest chain.  Tables are written to the shared folder each round; a hub's edges are pre-aggregated."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(label, both["a"] == label["id"]).select(F.col("b").alias("id"), "component")
        least = stored(near.union(label).groupBy("id").agg(F.min("component").alias("component")))
        jump = least.select(F.col("id").alias("_to"), F.col("component").alias("_far"))
        new = stored(least.join(jump, least["component"] == jump["_to"], "left").select("id", F.least("component", F.coalesce("_far", "component")).alias("component")))
        old = label.select("id", F.col("component").alias("_was"))
        moved = new.join(old, "id").where(F.col("component") != F.col("_was")).limit(1).count()
        drop(label), drop(least)
        label = new
        if not moved:
            drop(both)
            return label
