"""Prefix trie of conversations by an external mergesort that knows longest common prefixes.

A turn is a 128-bit code of role and text (from SHA-256) and its number of words; a conversation is the row of its codes.
Tasks sort runs of conversations and write each as the length of the prefix shared with the row before and the codes after
it.  Runs are cut at splitters, drawn from a bounded sample of (codes, id), into parts that are consecutive ranges of the
order; copies of one conversation are told apart by id, so any number of them divides over parts.  Each part merges its
runs with a loser tree whose players remember how many turns they share with the last row that won: players that share
more win without a comparison, and equal ones are compared from there on, so shared turns are never compared again.  The
merged rows drive a stack of the nodes on the open path; a node is finished when a row leaves it.

Nodes on a part's first or last path may go on in its neighbours: their counts are parts of sums, merged by node.  What
they add to their ancestors is summed within one part that has the node, for its ancestors are on the same path there.
Ids that end at such a node are joined in order of the parts, by a stream through one task (a hash of a list is sequential)
that holds one piece at a time.

Rows of null id form no conversation; null roles and texts are empty; turns of equal number (null first) are ordered by their
codes; repeated turns stay.  A conversation without turns is a member of the root only.  An empty table has no nodes.
A conversation's codes (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.store import arrow_map, stored

#: Bytes of a turn's code.
CODE = 16
#: Turns of a part, and how many parts at most (parts grow beyond); sampled rows a part, and turns of a splitter.
PART_TURNS, MAX_PARTS, DRAWN, SPLITTER_TURNS = 1 << 15, 4000, 20, 32
#: Rows and turns of a run.
RUN_ROWS, RUN_TURNS = 20_000, 400_000
#: Bytes of a piece of joined ids.
PIECE = 1 << 20
#: Of the conversation this far below, the first turns are shared.
SPAN = 20
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation with the first crc32 % 4 turns of the one whose id is the multiple of SPAN below."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, CODE)
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), code.alias("code"), words.alias("words")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words"))).alias("own"))
    below = F.col("conv_id") - F.col("conv_id") % SPAN
    first = own.where(F.col("conv_id") % SPAN == 0).select(F.col("conv_id").alias("_below"), F.slice("own", 1, 3).alias("first"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    none = F.array().cast("array<struct<code:binary,words:int>>")
    both = own.withColumn("_below", below).join(first, "_below", "left").withColumn("h", shared)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("first", none), 1, F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first turns two rows of codes share, `known` of them without looking."""
    i, most = known * CODE, min(len(a), len(b))
    if a[i:most] == b[i:most]:
        return most // CODE
    while a[i : i + CODE] == b[i : i + CODE]:
        i += CODE
    return i // CODE


def encode_run(rows: list[tuple[bytes, int, np.ndarray]]) -> dict:
    """A sorted run of (codes, id, words): what each row shares with the one before, and the rest of it."""
    ids, depths, lcps, codes, words, before = [], [], [], [], [], b""
    for key, conv, w in rows:
        n = shared_turns(before, key)
        ids.append(conv), depths.append(len(key) // CODE), lcps.append(n), codes.append(key[n * CODE :]), words.append(w[n:])
        before = key
    return {"ids": ids, "depths": depths, "lcps": lcps, "words": np.concatenate(words).tolist(), "codes": b"".join(codes), "last": before}


class Run:
    """A player of the loser tree: the row a run has come to, and how many turns it shares with the last winner."""

    __slots__ = ("_at", "_codes", "_depths", "_from", "_ids", "_lcps", "_words", "id", "key", "lcp", "words")

    def __init__(self, run: dict):
        self._ids, self._depths, self._lcps, self._words, self._codes = run["ids"], run["depths"], run["lcps"], run["words"], run["codes"]
        self._at, self._from, self.key, self.words, self.id, self.lcp = 0, 0, b"", [], 0, 0
        self.advance()

    def advance(self) -> None:
        i = self._at
        if i == len(self._ids):
            self.lcp = -1
            return
        n, m = self._lcps[i], self._depths[i] - self._lcps[i]
        self.key = self.key[: n * CODE] + self._codes[self._from * CODE : (self._from + m) * CODE]
        self.words = self.words[:n] + self._words[self._from : self._from + m]
        self.id, self.lcp = self._ids[i], n
        self._from += m
        self._at += 1

    def beats(self, other: Run) -> bool:
        """Whether this row comes first; the loser then knows how many turns it shares with the winner."""
        if self.lcp != other.lcp:
            return self.lcp > other.lcp
        if self.lcp < 0:
            return True
        n = shared_turns(self.key, other.key, self.lcp)
        a, b = self.key[n * CODE : (n + 1) * CODE], other.key[n * CODE : (n + 1) * CODE]
        first = (a, self.id) < (b, other.id) if a == b else a < b
        (other if first else self).lcp = n
        return first


def merged(runs: list[dict]) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """(id, turns shared with the row before, codes, words) of all runs in one order."""
    players = [Run(r) for r in runs]
    k = 1
    while k < len(players):
        k *= 2
    players += [Run({"ids": [], "depths": [], "lcps": [], "words": [], "codes": b""}) for _ in range(k - len(players))]
    for p in players:
        p.lcp = min(p.lcp, 0)
    losers: list = [None] * k

    def play(node: int) -> Run:
        if node >= k:
            return players[node - k]
        a, b = play(2 * node), play(2 * node + 1)
        losers[node] = b if (won := a.beats(b)) else a
        return a if won else b

    where = {id(p): i for i, p in enumerate(players)}
    winner = play(1)
    while winner.lcp >= 0:
        yield winner.id, winner.lcp, winner.key, winner.words
        node = (where[id(winner)] + k) // 2
        winner.advance()
        while node:
            if losers[node].beats(winner):
                losers[node], winner = winner, losers[node]
            node //= 2


class Node:
    __slots__ = ("children", "depth", "ends", "id", "kids", "leaves", "members", "open", "saved", "smallest", "words")

    def __init__(self, depth: int, words: int, open_: bool, id_):
        self.depth, self.words, self.open, self.id = depth, words, open_, id_
        self.members = self.children = self.leaves = self.saved = 0
        self.smallest, self.ends, self.kids = None, [], []


_NODES = (
    "kind int, part int, node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, place int, piece string"
)
_NODE_NAMES = [x.split()[0] for x in _NODES.split(", ")]
_ARROW = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
_NODE_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in map(str.split, _NODES.split(", "))])
#: Kinds of rows: finished nodes, finished nodes under an open one, an open node's sums, ids that end at an open node.
DONE, UNDER_OPEN, OPEN, ENDS = range(4)


def finished(part: int, runs: list[dict]) -> Iterator[tuple]:
    """The nodes of a part's merged rows, as rows of _NODES."""
    last = max(r["last"] for r in runs)
    stack: list[Node] = []
    digests = [hashlib.sha256()]  # of the open prefixes of the path, as far as they are needed

    def close() -> Iterator[tuple]:
        v = stack.pop()
        up = stack[-1] if stack else None
        if v.open:
            yield OPEN, part, v.id, up.id if up else None, v.depth, v.smallest, None, v.members, v.children, v.leaves, v.saved, v.words, None, None, None
            at, text = 0, []
            for i, c in enumerate(v.ends):
                text.append(str(c))
                if len(text) == PIECE // 20 or i == len(v.ends) - 1:
                    yield ENDS, part, v.id, None, v.depth, None, None, None, None, None, None, None, None, at, ",".join(text)
                    at, text = at + 1, []
        else:
            v.leaves += not v.children
            v.saved += (v.members - 1) * v.words
            hashed = hashlib.sha256(",".join(map(str, v.ends)).encode()).hexdigest() if v.ends else NOTHING
            mine = [DONE, part, None, None, v.depth, v.smallest, None, v.members, v.children, v.leaves, v.saved, v.words, hashed, None, None]
            up.children += 1
            if up.open:
                mine[0], mine[3] = UNDER_OPEN, up.id
                yield tuple(mine)
            else:
                up.kids.append(mine)
            for kid in v.kids:
                kid[6] = v.smallest
                yield tuple(kid)
        if up:
            up.members += v.members
            up.leaves += v.leaves
            up.saved += v.saved
            up.smallest = v.smallest if up.smallest is None else min(up.smallest, v.smallest)

    first = True
    for conv, shared, key, words in merged(runs):
        while stack and stack[-1].depth > shared:
            yield from close()
        for d in range(len(stack), len(key) // CODE + 1):
            is_open = first or d == 0 or stack[-1].open and key[(d - 1) * CODE : d * CODE] == last[(d - 1) * CODE : d * CODE] and last.startswith(key[: d * CODE])
            name = None
            if is_open:
                del digests[max(d, 1) :]
                if d:
                    digests.append(digests[-1].copy())
                    digests[-1].update(key[(d - 1) * CODE : d * CODE])
                name = digests[-1].digest()[:CODE]
            stack.append(Node(d, words[d - 1] if d else 0, is_open, name))
        first = False
        top = stack[-1]
        top.members += 1
        top.smallest = conv if top.smallest is None else min(top.smallest, conv)
        top.ends.append(conv)
    while stack:
        yield from close()


def _runs(conversations: DataFrame, splitters: list[tuple[bytes, int]]) -> DataFrame:
    from bisect import bisect_right

    def cut(rows: list) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:2])
        of = [bisect_right(splitters, r[:2]) for r in rows]
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and of[end] == of[at]:
                end += 1
            run = {"part": of[at]} | encode_run(rows[at:end])
            yield pa.RecordBatch.from_arrays([pa.array([run[f.name]], f.type) for f in schema], schema=schema)
            at = end

    schema = pa.schema([("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("depths", pa.list_(pa.int32())), ("lcps", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("codes", pa.binary()), ("last", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns = [], 0
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            for conv, t in zip(ids, batch.column("turns"), strict=True):
                values = t.values
                key = b"".join(values.field("code").to_pylist()) if len(values) else b""
                rows.append((key, conv, values.field("words").to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, np.int32)))
                turns += len(values)
            if len(rows) >= RUN_ROWS or turns >= RUN_TURNS:
                yield from cut(rows)
                rows, turns = [], 0
        if rows:
            yield from cut(rows)

    return arrow_map(conversations, run, "part int, ids array<bigint>, depths array<int>, lcps array<int>, words array<int>, codes binary, last binary")


def _splitters(conversations: DataFrame, part_turns: int) -> list[tuple[bytes, int]]:
    """Where parts begin, from DRAWN rows a part; none if one part is enough."""
    n, turns = conversations.agg(F.count("*"), F.sum(F.size("turns"))).first()
    parts = min(MAX_PARTS, -(-((turns or 0) + n) // part_turns))
    if parts < 2:
        return []
    drawn = conversations.where(F.pmod(F.xxhash64("conv_id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, parts * DRAWN / n) * (1 << 30)))
    rows = drawn.select(F.transform(F.slice("turns", 1, SPLITTER_TURNS), lambda t: t["code"]).alias("codes"), "conv_id").collect()  # DRAWN * MAX_PARTS or so
    keys = sorted((b"".join(map(bytes, r["codes"])), r["conv_id"]) for r in rows)
    return [keys[i * len(keys) // parts] for i in range(1, parts)] if len(keys) >= parts else keys


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    runs = table.drop_columns(["part"]).to_pylist()
    out, rows = [], []
    for row in finished(key[0].as_py(), runs):
        rows.append(row)
        if len(rows) == 50_000:
            out.append(_table(rows))
            rows = []
    return pa.concat_tables([*out, _table(rows)])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_NODE_NAMES), _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)


def _upwards(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a part's open nodes: what owned ones add to themselves and all their ancestors."""
    rows = rows.sort_values("depth", ascending=False)
    leaves, saved = dict(zip(rows["node"], rows["leaf"])), dict(zip(rows["node"], rows["gain"]))
    for node, parent in zip(rows["node"], rows["parent"], strict=True):
        if parent is not None:
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    return pd.DataFrame({"node": list(leaves), "add_leaves": list(leaves.values()), "add_saved": list(saved.values())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas, in the order they come in."""
    node, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])
    for batch in batches:
        for name, piece in zip(batch.column("node").to_pylist(), batch.column("piece"), strict=True):
            if name != node:
                if digest:
                    yield done()
                node, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py().encode())
    if digest:
        yield done()


def _count(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def trie(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Per node of the trie of (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    conversations = stored(conversations)
    runs = _runs(conversations, _splitters(conversations, part_turns))
    nodes = stored(runs.groupBy("part").applyInArrow(_merge, _NODES))
    parts = nodes.where(F.col("kind") == OPEN).select("part", "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")
    sums = parts.groupBy("node").agg(
        F.min("part").alias("owner"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    sums = stored(sums)
    kids = sums.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    ups = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    sums = stored(sums.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + _count(F.col("open_children"))).drop("open_children").join(ups, "parent", "left"))
    own = sums.select("node", "owner", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    mine = F.col("part") == F.col("owner")
    chains = parts.select("part", "node", "parent", "depth").join(own, "node").withColumns({"leaf": F.when(mine, F.col("leaf")).otherwise(0), "gain": F.when(mine, F.col("gain")).otherwise(0)})
    added = chains.groupBy("part").applyInPandas(lambda rows: _upwards(rows), "node binary, add_leaves bigint, add_saved bigint").groupBy("node").agg(F.sum("add_leaves").alias("add_leaves"), F.sum("add_saved").alias("add_saved"))
    pieces = nodes.where(F.col("kind") == ENDS).select("node", "part", "place", "piece").repartition("node").sortWithinPartitions("node", "part", "place").select("node", "piece")
    ends = arrow_map(pieces, _hashed, "node binary, ends_sha256 string")
    open_ = sums.join(added, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("add_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("add_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    names = open_.columns
    # a part's own rows of its open nodes, so that no key has more rows than a part
    smallest = parts.select("part", F.col("node").alias("parent")).join(ups, "parent")
    under = nodes.where(F.col("kind") == UNDER_OPEN).drop("parent_conv_id").join(smallest, ["part", "parent"]).select(names)
    return nodes.where(F.col("kind") == DONE).select(names).unionByName(under).unionByName(open_)
