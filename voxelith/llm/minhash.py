"""Near-duplicate documents by SetSketch registers.

A sketch has M registers.  Every element of a set draws points of a Poisson process; a point falls on one register, and
a register keeps the least of its points, on an exponential scale: K = floor(1 - log_B(A x)), cut to 0..Q+1.  So a
union's sketch is the register-wise maximum (``merge``), and two registers agree with about the sets' Jaccard similarity.

1. Each document's set of k-word shingles (the whole sequence, if it has fewer words; nothing without words) and its
   sketch are computed once.  Documents with equal sets are one class, represented by its smallest id.
2. Bands of R registers are hashed.  A band's members are paired with its smallest and its largest representative only, and
   of these pairs one a representative is tried in a round: that of most common bands whose ends are not yet connected.
3. The joint likelihood of (K_a > K_b, K_a < K_b, equal), given the set sizes, estimates the similarity; pairs far
   below the threshold are dropped (MARGIN is over seven standard deviations), the others are verified on full sets.
4. Components of the verified links.  Where a band still holds several components, further rounds try its members against
   the smallest representative outside the component of the band's smallest, the pivot, again one pair each.
5. What is left is decided by differences from the pivot p: with D_X = X xor p, |A xor B| = |D_A| + |D_B| - 2 |D_A and D_B|.
   Two sets linked to p are in its component, so let A be not linked to p; then D_A and D_B share at least t elements, t
   following from B's and p's sizes, so any |D_B| - t + 1 elements of D_B hold one of D_A's.  Elements that p lacks come
   first in the order of D_B, as copies of one document rarely share them.  A join on (p, element) with the positional filter
   (what comes before the first common element is not shared) finds every such pair without trying all pairs of a
   group of copies.  Pairs found are verified on full sets; components again.

With 32 bands of 4, a link at the threshold of 0.85 is missed with probability 1e-10, at 0.8 with 2e-8.
Elements are 64-bit hashes of words, so sets are full but for collisions (below 1e-12 a pair).

Null or empty texts have no shingles and are linked with nothing.  Rows that repeat a doc_id share its component; rows
of null doc_id take no part: component_id null, kept true.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxelith.llm.graph import components, sized
from voxelith.llm.store import arrow_map, drop, stored
from voxelith.llm.textbatch import chunks, mix, shingle_hashes, span_hashes, word_spans

M, R = 128, 4
BASE, RATE, TOP = 1.02, 20.0, 4096
MARGIN = 0.3
#: Rounds against the bands' ends, and further rounds against one member of each band that holds several components.
ENDS, STARS = 1, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, ascending, and the rows' ranges of them."""
    starts, ends, rows = word_spans(data, offsets)
    hashes, at = shingle_hashes(span_hashes(data, starts, ends, fold=True), rows, k)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(at)))


def sketch(elements: np.ndarray, at: np.ndarray, m: int = M) -> np.ndarray:
    """Registers (rows x m, int16) of each row's set; an empty set has zeros."""
    n = len(at) - 1
    least = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), np.diff(at))
    h, x, j, many = elements, np.zeros(len(elements)), 0, 1
    filled = np.flatnonzero(np.diff(at))
    while len(h):
        for _ in range(many):
            u = mix(h + np.uint64((j * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            x = x - np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / m
            np.minimum.at(least, owner * m + (mix(u) % np.uint64(m)).astype(np.int64), x)
            j += 1
        worst = np.full(n, -1.0)
        worst[filled] = least.reshape(n, m)[filled].max(axis=1)
        live = x < worst[owner]
        h, x, owner = h[live], x[live], owner[live]
        many = min(2 * many, 64)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(RATE * least) / np.log(BASE))
    k[np.isinf(least)] = 0
    return np.clip(k + TOP // 4, 0, TOP).astype("<i2").reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 101) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of register rows, given the set sizes."""
    more, less = (ka > kb).sum(1)[:, None], (ka < kb).sum(1)[:, None]
    same = ka.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, 0) + tiny)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s1, s2, regs): set size, two 64-bit sums that name the set, registers."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                h, at = shingle_sets(data, offsets, k)
                sums = []
                for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:], dtype=np.uint64)
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                regs = sketch(h, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(at) - 1), pa.array(np.diff(at)), *map(pa.array, sums), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "n", "s1", "s2", "regs"]
                )

    return arrow_map(kept, run, f"id {kept.schema[0].dataType.simpleString()}, n bigint, s1 bigint, s2 bigint, regs binary")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, elems): the sorted shingle hashes of the documents in ids."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sized(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                h, at = shingle_sets(data, offsets, k)
                sets = [h[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], ["id", "elems"])

    return arrow_map(kept, run, f"id {kept.schema[0].dataType.simpleString()}, elems binary")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The stored pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sized_ok = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(sized_ok)
    floor = percent / 100 - MARGIN

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                ka, kb = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<i2").reshape(-1, M) for c in (4, 5))
                ok = estimate(ka, kb, t.column(2).to_numpy().astype(float), t.column(3).to_numpy().astype(float)) >= floor
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok))

    near = stored(arrow_map(rows.select("a", "b", "na", "nb", "ra", "rb"), likely, f"a {kind}, b {kind}"))
    ids = stored(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct())
    sets = stored(full_sets(docs, ids, k, id_col, text_col))
    of = lambda x: sets.select(F.col("id").alias(x), F.col("elems").alias(f"e{x}"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                spot = np.minimum(np.searchsorted(p, q), len(p) - 1)
                both = int((p[spot] == q).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = stored(arrow_map(near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ea", "eb"), exact, f"a {kind}, b {kind}"))
    drop(near), drop(ids), drop(sets)
    return out


def differences(data: np.ndarray, pivot: np.ndarray, percent: int) -> tuple[np.ndarray, int, bool]:
    """Of a sorted set and its pivot: the difference's elements in order (those that the pivot lacks first, then by value), how
    many of the first must hold an element of the difference of any set that is linked to it but not to the pivot, and
    whether it is linked to the pivot itself."""
    spot = np.minimum(np.searchsorted(pivot, data), len(pivot) - 1)
    both = pivot[spot] == data
    d = np.concatenate([data[~both], np.setdiff1d(pivot, data, assume_unique=True)])
    shared = int(both.sum())
    linked = 100 * shared >= percent * (len(data) + len(pivot) - shared)
    n, m, q = len(data), len(d), 100 + percent
    t = max(1, (m * q + (100 - percent) * (len(pivot) - n)) // (2 * q) + 1)  # |D_A| exceeds (100 - percent) / q of |A| + |p|
    return d, max(0, m - t + 1), linked


def across_components(shared: DataFrame, label: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored links (a, b) with pivots, and stored pairs (a, b) of different components that share a band and may be linked (step 5)."""
    member = stored(shared.join(label, "id", "left").select("key", "id", "lo", F.coalesce("component", "id").alias("component")))
    mixed = stored(member.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key"))
    pairs = stored(member.join(mixed, "key").select(F.col("lo").alias("p"), F.col("id").alias("x"), "component").where("p <> x").distinct())
    ids = stored(pairs.select(F.col("p").alias("id")).union(pairs.select(F.col("x").alias("id"))).distinct())
    sets = stored(full_sets(docs, ids, k, id_col, text_col))
    of = lambda c: sets.select(F.col("id").alias(c), F.col("elems").alias(f"e{c}"))
    kind = pairs.schema["x"].dataType.simpleString()

    def emitted(t: pa.RecordBatch) -> pa.RecordBatch:
        rows, linked, first, elems, place, many, size = [], [], [], [], [], [], []
        for i, (x, y) in enumerate(zip(t.column(3), t.column(4), strict=True)):
            own = np.frombuffer(x.as_buffer(), "<u8")
            d, head, ok = differences(own, np.frombuffer(y.as_buffer(), "<u8"), percent)
            n = min(len(d), max(1, head)) if ok else len(d)
            rows.append(np.full(n, i, np.int32)), linked.append(np.full(n, ok)), first.append(np.arange(n) < head), elems.append(d[:n])
            place.append(np.arange(n, dtype=np.int32)), many.append(np.full(n, len(d), np.int32)), size.append(np.full(n, len(own), np.int32))
        at = pa.array(np.concatenate(rows))
        told = (pa.array(np.concatenate(v)) for v in (linked, first))
        return pa.RecordBatch.from_arrays(
            [*(t.column(c).take(at) for c in range(3)), *told, pa.array(np.concatenate(elems).astype(np.uint64).view(np.int64)), *(pa.array(np.concatenate(v)) for v in (place, many, size))],
            ["p", "x", "component", "linked", "first", "e", "place", "many", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, 64):  # few at a time, as differences may be as long as the sets
                yield emitted(t.slice(at, 64))

    both = pairs.join(of("x"), "x").join(of("p"), "p").select("p", "x", "component", "ex", "ep")
    fields = f"p {kind}, x {kind}, component {kind}, linked boolean, first boolean, e bigint, place int, many int, size int"
    rows = stored(arrow_map(both, run, fields))
    links = stored(rows.where("linked and place = 0").select(F.least("p", "x").alias("a"), F.greatest("p", "x").alias("b")).distinct())
    side = lambda x: ["p", "e", *(F.col(c).alias(f"{c}{x}") for c in ("x", "component", "place", "many", "size"))]
    left, right = rows.where("not linked").select(*side("a"), F.col("first").alias("firsta")), rows.where("first").select(*side("b"), F.col("linked").alias("linkedb"))
    shared_at_most = F.least(F.col("manya") - F.col("placea"), F.col("manyb") - F.col("placeb"))
    close = (100 + percent) * (F.col("manya") + F.col("manyb") - 2 * shared_at_most) <= (100 - percent) * (F.col("sizea") + F.col("sizeb"))
    alike = 100 * F.least("sizea", "sizeb") >= percent * F.greatest("sizea", "sizeb")
    # the least element that two differences share is among the first of both, unless the pivot is linked to one of them
    found = left.join(right, ["p", "e"]).where("componenta <> componentb").where(close & alike & (F.col("firsta") | F.col("linkedb")))
    out = stored(found.select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b")).distinct())
    drop(member), drop(mixed), drop(pairs), drop(ids), drop(sets), drop(rows)
    return links, out


def _best(pairs: DataFrame, label: DataFrame, tested: DataFrame) -> DataFrame:
    """Stored pairs (a, b), one a representative x at most, of pairs (x, p, n): that of greatest n, then least p, whose ends are
    in different components and that is not in tested."""
    of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    apart = pairs.join(of("x"), "x", "left").join(of("p"), "p", "left").where(F.coalesce("cx", "x") != F.coalesce("cp", "p"))
    apart = apart.select("x", "n", "p", F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).join(tested, ["a", "b"], "left_anti")
    best = apart.groupBy("x").agg(F.min(F.struct(-F.col("n"), "p")).alias("m")).select("x", "m.p")
    return stored(best.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct())


def _second(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Stored (x, p, n): members of bands that hold several components, with the smallest outside the component of the band's smallest."""
    member = shared.join(label, "id", "left").select("key", "id", "lo", F.coalesce("component", "id").alias("c"))
    member = stored(member.join(label.select(F.col("id").alias("lo"), F.col("component").alias("cl")), "lo", "left").select("key", "id", "c", F.coalesce("cl", "lo").alias("cl")))
    second = stored(member.where("c <> cl").groupBy("key").agg(F.min(F.struct("id", "c")).alias("s")).select("key", "s.id", "s.c").toDF("key", "p", "cp"))
    out = stored(member.join(second, "key").where("c <> cp and id <> p").groupBy(F.col("id").alias("x"), "p").agg(F.count("*").alias("n")))
    drop(member), drop(second)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    all_rows = stored(sketches(docs, k, id_col, text_col))
    here = all_rows.where("n > 0 and id is not null")
    reps = stored(here.groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "regs")).alias("r")).select("s1", "s2", "r.*"))
    width = 2 * R
    bands = reps.select("id", F.explode(F.sequence(F.lit(0), F.lit(M // R - 1))).alias("band"), "regs").select(
        F.xxhash64("band", F.substring("regs", F.col("band") * width + 1, F.lit(width))).alias("key"), "id"
    )
    pivots = stored(bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"))
    shared = stored(bands.join(pivots, "key"))
    ends = F.explode(F.array("lo", "hi")).alias("p")
    star = stored(shared.select(F.col("id").alias("x"), ends).where("x <> p").groupBy("x", "p").agg(F.count("*").alias("n")))
    kind = reps.schema["id"].dataType
    spark = docs.sparkSession
    none = spark.createDataFrame([], StructType([StructField("a", kind), StructField("b", kind)]))
    links, tested, label = none, none, components(none)
    for turn in range(ENDS + STARS):
        pairs = _best(star if turn < ENDS else _second(shared, label), label, tested)
        if pairs.limit(1).count():
            links = stored(links.union(verified(pairs, reps, docs, k, percent, id_col, text_col)))
            tested = stored(tested.union(pairs))
            label = components(links)
    more, across = across_components(shared, label, docs, k, percent, id_col, text_col)
    links = stored(links.union(more).union(verified(stored(across.join(tested, ["a", "b"], "left_anti")), reps, docs, k, percent, id_col, text_col)))
    label = components(links)
    named = reps.select("s1", "s2", F.col("id").alias("rep")).join(label, F.col("rep") == label["id"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    named = stored(named)
    whole = here.join(named, ["s1", "s2"]).select("id", "n", "component_id")
    alone = all_rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = whole.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that a smaller id of their component stands for."""
    gone = stored(near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col(id_col)).distinct())
    return docs.join(sized(gone), id_col, "left_anti")
