"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors become integers, floor(SCALE * x).  A block of index rows holds one posting segment per (dimension, level): the
rows whose component lies in that level's range, with their components.  For a query, a row gains at least ``base`` in each
dimension, and a segment's impact is the most that one of its rows gains there beyond that.  Impacts are quantised to STEPS
steps and segments are processed by descending step: every row of a segment gets its gain added to an accumulator.  So an
accumulator is a lower bound of the row's score, and with the most that each dimension's segments still to come can give
it is an upper bound.  Many queries are processed at once, each with its own segments of the step, as products of
matrices.  After each step a query stops
if its k-th lower bound proves that few enough rows can still be members; those, all of them, are scored exactly.  After
the last step accumulators are exact.  Sums are of integers below 2^24 in float32, or else below 2^53 in float64, so the
proof has no rounding.

Query blocks meet index blocks in a grid, so no side is broadcast or collected; each cell keeps at most k rows a
query, and a query's cells are merged.

Vectors that are null, or hold null or non-finite components, or differ in length from the query's, take no part.  A
query's own row (equal id) is no candidate.  Ties go to the smaller id; rows that repeat an id are each candidates,
and a query that repeats is answered once.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
LEVELS = 4
#: Steps that impacts are quantised to.
STEPS = 8
#: A query stops when no more rows than this many times k can be members (or when nothing is left).
FEW = 16
#: Rows of an index block and of a query block, about.
INDEX_ROWS, QUERY_ROWS = 8192, 2048
#: Queries that are processed at once.
QUERIES = 64


def integers(rows: DataFrame, key: str, vec: str, scale: int) -> DataFrame:
    """(id, v): usable rows with their integer vectors."""
    good = F.col(key).isNotNull() & F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(good).select(F.col(key).alias("id"), F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("v"))


class Block:
    """Posting segments of some index rows.  Segment (d, j) holds the rows of level j in dimension d and their components; the
    segments of a level lie together, as planes of components and of marks, so that many queries process theirs at once."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, levels: int = LEVELS):
        self.ids, self.v, self.dims, self.levels = ids, v, v.shape[1], levels
        order = np.sort(v, axis=0)
        cuts = order[np.linspace(0, len(v) - 1, levels + 1).astype(int)[1:-1]]  # equal shares of the block's rows
        level = (v[:, :, None] >= cuts.T[None, :, :]).sum(2) if levels > 1 else np.zeros(v.shape, int)
        marks = [level.T == j for j in range(levels)]  # dimensions x rows
        self.used = np.stack([m.any(1) for m in marks], 1)
        of = lambda none: np.stack([np.where(m, v.T, none) for m in marks], 1)
        far = np.abs(v).max() + 1
        self.low, self.high = (np.where(self.used, x, 0).astype(float) for x in (of(far).min(2), of(-far).max(2)))
        self.largest = int(far)
        self._planes: dict = {}
        self.processed = 0  # segments, over all queries
        self._marks = marks

    def planes(self, kind) -> list[np.ndarray]:
        """For each level, the components of its segments and below them their marks (2 x dimensions, by rows)."""
        if kind not in self._planes:
            self._planes = {kind: [np.concatenate([np.where(m, self.v.T, 0), m]).astype(kind) for m in self._marks]}
        return self._planes[kind]

    def search(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, index row, score) of each query's k best here."""
        n, weight = len(self.v), q.astype(float)
        # sums of integers are exact in 32 bits below 2^24, in 64 bits below 2^53
        kind = np.float32 if 4 * self.dims * self.largest * (np.abs(q).max(initial=0) + 1) < 1 << 24 else np.float64
        ends = weight[:, :, None] * self.low, weight[:, :, None] * self.high  # queries x dimensions x levels
        base = np.where(self.used, np.minimum(*ends), np.inf).min(2)
        impact = np.where(self.used, np.maximum(*ends) - base[:, :, None], -1.0)
        step = np.where(self.used, np.ceil(STEPS * impact / np.maximum(impact.max((1, 2), keepdims=True), 1.0)), -1).astype(int)
        gains = np.concatenate([weight, -base], 1)
        sums = np.repeat(base.sum(1)[:, None], n, 1).astype(kind)
        own = self.ids[None, :] == qids[:, None]
        active, out = np.arange(len(q)), []
        for now in range(STEPS, -1, -1):
            chosen = step[active] == now
            if now and not chosen.any():
                continue
            for j, plane in enumerate(self.planes(kind)):
                mine = chosen[:, :, j]
                if mine.any():
                    self.processed += int(mine.sum())
                    sums += (gains[active] * np.concatenate([mine, mine], 1)).astype(kind) @ plane
            left = np.where(step[active] < now, impact[active], 0).max(2).sum(1)
            least = np.where(own, -np.inf, sums)
            kth = np.partition(least, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
            able = (sums + left[:, None].astype(kind) >= kth[:, None]) & ~own
            stops = np.ones(len(active), bool) if not now else able.sum(1) <= FEW * k
            for i in np.flatnonzero(stops):
                rows = np.flatnonzero(able[i])
                score = self.v[rows] @ q[active[i]]
                take = np.lexsort((self.ids[rows], -score))[:k]
                out.append((np.full(len(take), active[i]), rows[take], score[take]))
            if stops.any():
                active, sums, own = active[~stops], sums[~stops], own[~stops]
            if not len(active):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products."""
    rows, asked = integers(index, key, vec, scale), integers(queries, key, vec, scale).dropDuplicates(["id"])
    ib = max(1, -(-index.count() // INDEX_ROWS))
    qb = max(1, -(-queries.count() // QUERY_ROWS))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id", "v"), F.lit(ib)).cast("int").alias("ib"), cells(qb).alias("qb"))
    right = asked.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int").alias("qb"), cells(ib).alias("ib"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(a) or not len(b) or not a.d.iloc[0]:
            return none
        ids, qids = a.id.to_numpy(), b.id.to_numpy()
        block = Block(ids, np.stack(a.v.to_numpy()).astype(np.int64))
        q = np.stack(b.v.to_numpy()).astype(np.int64)
        got = []
        for at in range(0, len(q), QUERIES):
            i, j, s = block.search(qids[at : at + QUERIES], q[at : at + QUERIES], k)
            got.append(pd.DataFrame({"query_id": qids[at : at + QUERIES][i], "id": ids[j], "score": s}))
        return pd.concat(got)

    near = left.groupBy("ib", "qb", "d").cogroup(right.groupBy("ib", "qb", "d")).applyInPandas(cell, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
