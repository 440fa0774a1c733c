"""Best-fit packing of token sequences by a configuration linear program.

1. Tokenise once; documents longer than the capacity are cut, the first piece taking what is left over.
2. The histogram of piece lengths (at most ``capacity`` entries, whatever the corpus) is all that the driver sees.
3. Multiplicative weights solve the fractional configuration program: each length has a price, a knapsack dynamic program
   gives the most valuable configuration of every room, hence of every length that must be in it; those near the best
   are used, and the prices of what they cover fall.  Any prices bound the number of sequences from below (their total
   value over the best configuration's), so the program ends at a stated GAP between that and what it uses, or after ROUNDS.
4. Uses are rounded: a configuration is taken as often as its rounded use and the pieces still there allow, if it fills FULL of a
   sequence.  The program is solved again for what is left while a solution places a tenth of it; the rest is placed by
   best fit, longest first, over lengths.
5. Each piece gets its rank among those of its length (salted, so that one common length is spread over tasks) and the
   plan turns (length, rank) into a sequence and a place in it.

Null or empty texts are the end token alone.  Repeated rows are packed as often as they occur.  An empty table gives no
rows.  The plan's size depends on the capacity, not on the corpus.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.store import arrow_map, stored
from voxelith.llm.textbatch import WordTable, chunks, gather, pretokens

CAPACITY = 2048
#: Rounds of multiplicative weights at most, solutions for what is left at most, and the relative gap at which rounds end.
ROUNDS, SOLUTIONS, GAP = 40, 3, 0.01
#: Share of a sequence that a rounded configuration must fill.
FULL = 0.999
#: Distinct pieces of text that a worker remembers; beyond that it starts anew.
REMEMBERED = 800_000
#: Rows that one salt of a length should have, about.
PER_SALT = 20_000


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(2)
def _table(path: str) -> WordTable:
    """Each match of the pattern is encoded by itself, as the byte-level model does.  One a worker, kept from task to task."""

    def fill(pieces: list[bytes]) -> list[bytes]:
        out = _tokenizer(path).encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in out]

    return WordTable(fill, REMEMBERED)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and the ids if asked for."""
    kept = docs.select(id_col, text_col)
    schema = f"{id_col} {kept.schema[0].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            row, piece, begin, length, crc, toks = [], [], [], [], [], []
            for first, data, offsets in chunks(batch.column(1)):
                starts, ends, rows = pretokens(data, offsets)
                codes, values = table.lookup(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), [])
                at = np.zeros(len(values) + 1, np.int64)
                np.cumsum([len(v) // 4 for v in values], out=at[1:])
                ids, id_at = gather(np.frombuffer(b"".join(values), np.uint32), at, codes)
                cut = id_at[rows].tolist()
                for i in range(len(offsets) - 1):
                    own = np.append(ids[cut[i] : cut[i + 1]], np.uint32(end_id)).astype("<u4")
                    n, k = len(own), 0
                    head = n % capacity or capacity
                    a, b = 0, head
                    while a < n:
                        row.append(first + i), piece.append(k), begin.append(a), length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].data))
                        if with_ids:
                            toks.append(own[a:b].astype(np.int32))
                        a, b, k = b, b + capacity, k + 1
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, crc))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(toks, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(kept, run, schema)


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the greatest value of each room, and the item to take first there (-1: leave one unit)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        best[room] = best[room - 1]
        if n:
            score = best[room - lengths[:n]] + values[:n]
            i = int(score.argmax())
            if score[i] > best[room]:
                best[room], took[room] = score[i], i
    return best, took


def _filled(first: int, lengths: np.ndarray, took: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration (index of length -> how often) that holds ``first``."""
    config, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        i = int(took[room])
        if i < 0:
            room -= 1
            continue
        config[i] = config.get(i, 0) + 1
        room -= int(lengths[i])
    return config


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float, float]:
    """Uses of configurations (tuples of (index, how often)) that cover need, how many those are in all, and a lower bound of
    any solution's number: the fractional configuration program by multiplicative weights."""
    covered, weight, uses, bound, primal = np.zeros(len(lengths)), np.ones(len(lengths)), {}, 0.0, float("inf")
    for turn in range(1, rounds + 1):
        values = lengths * weight
        best, took = _price(values, lengths, capacity)
        bound = max(bound, float(values @ need) / best[capacity])
        near = np.flatnonzero(values + best[capacity - lengths] >= (1 - 2 * GAP) * best[capacity])
        fresh = np.ones(len(lengths), bool)
        for i in near[np.argsort(covered[near], kind="stable")].tolist():  # one configuration for each length not yet in one, those least covered first
            if fresh[i]:
                config = _filled(i, lengths, took, capacity)
                often = need[i] / config[i]  # as often as this length needs
                key = tuple(sorted(config.items()))
                uses[key] = uses.get(key, 0.0) + often
                for j, n in config.items():
                    covered[j] += often * n / need[j]
                    fresh[j] = False
        least = covered.min()
        if least > 0:
            primal = sum(uses.values()) / least
            if primal <= (1 + GAP) * bound:
                break
        weight *= np.exp(-0.1 * (covered - covered.mean()) / max(covered.mean(), 1e-9))
    scale = bound / sum(uses.values())
    return {k: v * scale for k, v in uses.items()}, primal, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, said: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> how often) with how many sequences use each; together they hold the histogram exactly.
    said: gets the sequences that the program placed, and the primal and dual value of its first solution."""
    left = {int(k): int(v) for k, v in sorted(histogram.items()) if v > 0}
    out: list[tuple[dict[int, int], int]] = []
    for _ in range(SOLUTIONS if rounds else 0):
        lengths = np.array([k for k, v in left.items() if v], np.int64)
        if not len(lengths):
            break
        have = np.array([left[int(k)] for k in lengths])
        uses, primal, bound = solve(lengths, have.astype(float), capacity, rounds)
        if said is not None:
            said.setdefault("primal", primal), said.setdefault("dual", bound)
        placed, total = 0, int(have @ lengths)
        for config, use in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
            size = sum(int(lengths[i]) * n for i, n in config)
            times = min([max(1, round(use)), *(int(have[i]) // n for i, n in config)])
            if times and size >= FULL * capacity:
                for i, n in config:
                    have[i] -= n * times
                out.append(({int(lengths[i]): n for i, n in config}, times))
                placed += size * times
        left = {int(k): int(v) for k, v in zip(lengths, have, strict=True)}
        if placed < 0.1 * total:
            break
    if said is not None:
        said["program"] = sum(n for _, n in out)
    return out + _best_fit({k: v for k, v in left.items() if v}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequence that has room.  Equal sequences are held as one with a count, so the
    work follows the number of different lengths and fillings, not the number of pieces."""
    groups: dict[int, list[list]] = {}  # room -> [configuration, how many]
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in sorted(r for r in groups if r >= length):
            if not n:
                break
            mine, fit = groups.pop(room), room // length
            for config, many in mine:
                full = min(many, n // fit) if n else 0
                n -= full * fit
                rest = many - full
                if full:
                    groups.setdefault(room - fit * length, []).append([config | {length: config.get(length, 0) + fit}, full])
                if rest and n:
                    groups.setdefault(room - n * length, []).append([config | {length: config.get(length, 0) + n}, 1])
                    n, rest = 0, rest - 1
                if rest:
                    groups.setdefault(room, []).append([config, rest])
        if n:
            fit = capacity // length
            if n // fit:
                groups.setdefault(capacity - fit * length, []).append([{length: fit}, n // fit])
            if n % fit:
                groups.setdefault(capacity - n % fit * length, []).append([{length: n % fit}, 1])
    return [(config, many) for _, found in sorted(groups.items()) for config, many in found]


def _slots(configs: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks at which a configuration's share of it begins, first sequence, how many a sequence has, offset."""
    found: dict[int, list] = {}
    seen: dict[int, int] = {}
    base = 0
    for config, many in configs:
        offset = 0
        for length, times in sorted(config.items(), reverse=True):
            at = seen.get(length, 0)
            found.setdefault(length, []).append((at, base, times, offset))
            seen[length] = at + times * many
            offset += times * length
        base += many
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def assign(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with ``length``) and sequence_id, offset.  pieces is read three times: pass a stored table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan(histogram, capacity, rounds))
    salts = F.split(F.lit(",".join(str(-(-histogram.get(n, 1) // PER_SALT)) for n in range(capacity + 1))), ",").cast("array<int>")  # by length
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.get(salts, F.col("length").cast("int"))).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.join(before, ["length", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    )
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                here = np.flatnonzero(length == k)
                at, base, times, offset = slots[int(k)]
                i = np.searchsorted(at, rank[here], "right") - 1
                r = rank[here] - at[i]
                seq[here], off[here] = base[i] + r // times[i], offset[i] + r % times[i] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return arrow_map(ranked.select(*names, "_rank"), place, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut, plan and place."""
    return assign(stored(token_pieces(docs, path, capacity, id_col=id_col, text_col=text_col)), capacity, order=(id_col, "piece"))
