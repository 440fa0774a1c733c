"""Toxicity by compression distance: windows are compressed with zstandard dictionaries of toxic and of ordinary text.

Training counts, over a bounded sample of labelled documents (MAX_TOXIC, MAX_ORDINARY), in how many of them each segment
of a word occurs.  A dictionary is made of the segments that mark its class (likelihood ratio of at least RATIO, evidence
of at least EVIDENCE nats, all inner segments alike), the strongest nearest to the end, where references to them are
shortest.  The toxic class has two, of segments that ordinary text hardly has (ratio of at least STRONG) and of the others.
A text's words, lower-cased, joined by one space, are cut into windows; a window's gains are by how many bytes each toxic
dictionary compresses it further than the ordinary one.  Thresholds are calibrated on the sample: each pair of gains has
the logarithm of how much likelier it is in toxic windows, a document's evidence is their sum, and a logistic curve over
evidence and length, weighted to the classes' true sizes, turns it into the score.

A null or empty text has one empty window, and so the score of a text that shows nothing.  Without labelled documents of
both classes every score is 0.  Rows of null id are not trained on; documents with several labels count as toxic if one of
them is; repeated rows get equal scores.  Whole texts are read, in pieces of PIECE characters that end between words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.store import arrow_map, drop, stored

#: Bounds of the labelled sample that dictionaries and thresholds are fitted on.
MAX_TOXIC, MAX_ORDINARY = 4_000, 8_000
#: Segments: lengths in characters, least bytes (that of a match), least documents, likelihood ratios and evidence.
LENGTHS, MATCH, LEAST, RATIO, STRONG, EVIDENCE = (5, 10), 6, 5, 3.0, 60.0, 12.0
#: Bytes of a dictionary; how many of the best segments are looked at for it.
DICTIONARY, CANDIDATES = 1024, 4000
#: Bytes of a window, and by how many it reaches into the next, so that no word is cut in both.
WINDOW, REACH = 96, 12
#: Gains beyond are one class of their own.
TOP = 7
PIECE = 1 << 20
TOXIC_FROM = 0.7
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
#: Ends every window and dictionary: no text has it, so the frame is always compressed and its last words are searched.
_END = bytes([0, 1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20]) * 2


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def windows(text: str | None) -> Iterator[bytes]:
    """The whole text's windows; a text without words has one, empty."""
    text, at, left = text or "", 0, b" "
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _WORD.match(text[end]):
            end += 1
        left += "".join(f"{w} " for w in _WORD.findall(text[at:end].lower())).encode("utf-8", "replace")
        at, i = end, 0
        while len(left) - i > WINDOW + REACH:
            yield left[i : i + WINDOW + REACH] + _END
            i += WINDOW
        left = left[i:]
    yield left + _END


class Model:
    """Dictionaries, evidence of each pair of gains, and the curve; a few KB whatever the corpus."""

    def __init__(self, ordinary: bytes, strong: bytes, weak: bytes):
        self.dictionaries = (ordinary, strong, weak)
        self.evidence = np.zeros((TOP + 1) ** 2)
        self.curve = None
        self._compress = None

    def __getstate__(self):
        return {**self.__dict__, "_compress": None}

    def gains(self, text: str | None) -> np.ndarray:
        """How many of the text's windows have each pair of gains."""
        if self._compress is None:
            self._compress = [_compressor(d) for d in self.dictionaries]
        ordinary, strong, weak = self._compress
        out = np.zeros((TOP + 1) ** 2, np.int64)
        for w in windows(text):
            n = len(ordinary(w))
            out[(TOP + 1) * min(max(n - len(strong(w)), 0), TOP) + min(max(n - len(weak(w)), 0), TOP)] += 1
        return out

    def fit(self, counts: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
        """Evidence and curve, from the documents' counts, classes and weights."""
        seen = np.stack([counts[~toxic].sum(0), counts[toxic].sum(0)]).astype(float)
        share = seen.sum(0) / seen.sum()
        rate = (seen + 2 * share) / (seen.sum(1, keepdims=True) + 2)
        self.evidence = np.where(share > 0, np.log(np.maximum(rate[1], 1e-300)) - np.log(np.maximum(rate[0], 1e-300)), 0.0)
        x, w = self._features(counts), np.zeros(4)
        for _ in range(60):  # Newton's method with a small penalty
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(4), x.T @ (weight * (p - toxic)) + 1e-2 * w)
            w = w - step / max(1.0, np.abs(step).max() / 2)
        self.curve = w
        return self

    def _features(self, counts: np.ndarray) -> np.ndarray:
        e = counts @ self.evidence
        return np.c_[np.sign(e) * np.log1p(np.abs(e)), np.clip(e, -5, 5), np.log(np.maximum(counts.sum(1), 1)), np.ones(len(counts))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None or not texts:
            return np.zeros(len(texts))
        z = self._features(np.stack([self.gains(t) for t in texts])) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _compressor(dictionary: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters(
        strategy=z.STRATEGY_FAST, target_length=1, min_match=MATCH, window_log=16, hash_log=14, chain_log=10, search_log=1, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS
    )
    d = z.ZstdCompressionDict(dictionary + _END, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=d, compression_params=how).compress


def _segments(sample: DataFrame) -> DataFrame:
    """(segment, n0, n1): in how many ordinary and toxic documents words with it occur, counted once a word and document."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1))).alias("word"))
    counted = words.groupBy("word").agg(F.sum(F.when(F.col("toxic"), 0).otherwise(1)).alias("n0"), F.sum(F.when(F.col("toxic"), 1).otherwise(0)).alias("n1"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    cut = lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.flatten(F.array(*[cut(F.lit(n)) for n in range(LENGTHS[0], LENGTHS[1] + 1)])))
    return counted.where(F.length("word") <= 64).select("n0", "n1", F.explode(every).alias("segment")).groupBy("segment").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _dictionary(segments: DataFrame, mine: str, other: str, total: dict, low: float, high: float) -> bytes:
    me, them = total[mine], total[other]
    a, b = F.col(mine), F.col(other)
    ratio = lambda x, y: (x + 0.5) / me / ((y + 0.5) / them)
    shared = (a + b) / (me + them)
    evidence = a * F.log(a / (shared * me)) + F.when(b > 0, b * F.log(b / (shared * them))).otherwise(0.0)
    best = segments.where((a >= LEAST) & (F.octet_length("segment") >= MATCH)).withColumn("ratio", ratio(a, b)).withColumn("evidence", evidence)
    best = best.where((F.col("ratio") >= low) & (F.col("ratio") < high) & (F.col("evidence") >= EVIDENCE))
    rows = best.orderBy(F.desc("evidence"), F.desc(F.length("segment")), "segment").limit(CANDIDATES).select("segment").collect()
    candidates = [r["segment"] for r in rows]
    inner = sorted({q[i : i + MATCH] for q in candidates for i in range(len(q) - MATCH + 1)})
    common = set()
    if inner:  # at most five for each of CANDIDATES
        asked = segments.sparkSession.createDataFrame([(x,) for x in inner], "segment string")
        common = {r["segment"] for r in segments.join(F.broadcast(asked), "segment").where(ratio(a, b) < 2).select("segment").collect()}
    out: list[str] = []
    size = 0
    for q in candidates:
        if any(q[i : i + MATCH] in common for i in range(len(q) - MATCH + 1)) or any(q in x for x in out):
            continue
        size += len(q.encode())
        if size > DICTIONARY:
            break
        out.append(q)
    return "".join(reversed(out)).encode()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """From documents (key, text) with labels (key, toxic); nulls in key or label are left out."""
    labels = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Model(b"", b"", b"")
    if not sizes.get(True) or not sizes.get(False):
        return none
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    rate = {c: min(1.0, most / sizes[c]) for c, most in ((True, MAX_TOXIC), (False, MAX_ORDINARY))}
    drawn = labels.where(draw < F.when(F.col("toxic"), rate[True]).otherwise(rate[False]))  # bounded, so documents need no exchange
    sample = stored(docs.select(key, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), key).select("text", "toxic"))
    segments = stored(_segments(sample).where(F.col("n0") + F.col("n1") >= 2))
    total = segments.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return none
    total = total.asDict()
    model = Model(
        _dictionary(segments, "n0", "n1", total, RATIO, math.inf), _dictionary(segments, "n1", "n0", total, STRONG, math.inf), _dictionary(segments, "n1", "n0", total, RATIO, STRONG)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.gains(t.as_py()).astype(np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column(1)], ["gains", "toxic"])

    rows = arrow_map(sample, run, "gains binary, toxic boolean").collect()  # a few hundred bytes for each document of the bounded sample
    drop(sample), drop(segments)
    toxic = np.array([r["toxic"] for r in rows])
    counts = np.stack([np.frombuffer(r["gains"], np.int32) for r in rows]).astype(np.int64)
    return model.fit(counts, toxic, np.where(toxic, 1 / rate[True], 1 / rate[False])) if 0 < toxic.sum() < len(toxic) else none


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(key, held_out(F.col(key)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores([t.as_py() for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= TOXIC_FROM).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return arrow_map(kept, run, f"`{key}` {kept.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
