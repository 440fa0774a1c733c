"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased whole text, (1 + ln tf) * idf, of unit length.  Document
frequencies count every training document.  Weights are trained by follow-the-regularised-leader (FTRL-proximal, per
coordinate rates, elastic-net penalties L1 and L2) on a bounded sample of labelled rows: PER_CLASS a language, MAX_SAMPLE
in all.  A fifth of the sample is set aside to fit the temperature that calibrates the scores.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing is labelled.  Rows of null id are
never trained on.  Repeated rows get equal predictions.  Every language of the training rows is a class; only its sample is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.store import arrow_map

#: Hash buckets of n-grams.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bounds of the labelled sample that the classifier is fitted on.
PER_CLASS, MAX_SAMPLE = 400, 8000
#: FTRL: rate, smoothing, penalties, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    key = np.zeros(len(points), np.uint64)
    for order, mult in zip(ORDERS, _MULT, strict=True):
        if len(points) < order:
            break
        key = key[: len(points) - order + 1] * np.uint64(0x10001 * 2 + 1) + points[order - 1 :] * mult
        mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount((mixed >> shift).astype(np.int64), minlength=buckets)
    return out


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's unit vector."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, (x / norm if norm > 0 else x)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[:-1] += ngram_counts(text.as_py()) > 0
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])

    rows = arrow_map(train.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 at most
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (buckets + 1 x classes; the last row is the bias), mostly exact zeros."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zs) <= L1] = 0
        return w

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(buckets + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The positive number that, dividing the logits, makes y likeliest (golden-section search on its logarithm)."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, classes: list[str], weights: np.ndarray, idf: np.ndarray, heat: float):
        self.classes, self.weights, self.idf, self.heat = classes, weights.astype(np.float32), idf.astype(np.float32), heat

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = features(counts, self.idf)
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return "und", 0.0
        p = _softmax(self.logits(ngram_counts(text)).astype(float) / self.heat)
        i = int(p.argmax())
        return self.classes[i], float(p[i])


def fit(train: DataFrame, key: str = "doc_id") -> Model:
    """From rows with text and lang; nulls in either are left out."""
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col(key).isNotNull()).select(key, "text", "lang")
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    classes = sorted(r["lang"] for r in sizes)
    if not classes:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(BUCKETS), 1.0)
    df, n = _document_frequency(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    per_class = max(4, min(PER_CLASS, MAX_SAMPLE // len(classes)))
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(per_class / r["n"])).otherwise(rate)
    drawn = train.where(draw < rate).orderBy(draw / rate, key).limit(max(MAX_SAMPLE, 8 * len(classes)))  # what is over the bound goes from all languages alike
    where = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(ngram_counts(t.as_py()), idf) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())], ["lang", "at", "x"]
            )

    rows = [
        (np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float), where[r["lang"]])
        for r in arrow_map(drawn.select("text", "lang"), run, "lang string, at binary, x binary").toLocalIterator()
    ]
    aside = rows[::5] if len(rows) >= 20 else []
    used = [r for i, r in enumerate(rows) if i % 5] if aside else rows
    weights = train_ftrl(used, len(classes))
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in aside]).reshape(len(aside), len(classes))
    return Model(classes, weights, idf, temperature(logits, np.array([y for *_, y in aside], int)))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on BUCKETS and the number of languages only
    kept = docs.select(key, held_out(F.col(key)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [key, "held_out", "lang_pred", "score"]
            )

    return arrow_map(kept, run, f"`{key}` {kept.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
