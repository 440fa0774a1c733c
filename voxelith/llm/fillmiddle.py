"""Fill-in-the-middle: documents are cut at two token borders and put together anew around sentinels.

Tokens are `[A-Za-z]+|[^A-Za-z]`, matched left to right over code points: a two-state automaton (in a run of letters, or
not) that emits one token where a run begins and one for every other code point.  A text is scanned in chunks that know
nothing of each other: each gives its transition (the state it ends in, from each state it may begin in) and its counts of
tokens (from each state).  Transitions and counts are composed in order of the chunks, which is associative, so each
chunk's entry state and first token number are known without reading its neighbours again; only the chunk that holds a
cut is searched for its place.

Texts of up to CHUNK bytes are one chunk, and are scanned, cut and hashed where they are read, in one pass.  Longer
ones are split into rows of a chunk each; their summaries (a few numbers a chunk) are composed by groups of GROUP chunks
and then over the groups; chunks are matched with the cuts that fall into them, and the places found meet the document again.

Null text counts as empty; a null id is hashed as if its decimal were empty; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.store import arrow_map, stored
from voxelith.llm.textbatch import string_buffers

CHUNK = 1 << 16
#: Chunks whose summaries are composed at once; a document has few groups.
GROUP = 64
#: Fixed values of the output forms: sentinels, and the shares in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that begin a code point.
_HEAD = (np.arange(256) & 0xC0) != 0x80

_PLACES = "place_a bigint, place_b bigint, points_a bigint, points_b bigint"


def scan(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of data[bounds[i]:bounds[i+1]]: the states it ends in and the tokens it emits from either state
    (n x 2 each), its code points, and whether each byte begins a token if its row begins outside a run."""
    letter, head = _LETTER[data], _HEAD[data]
    begins = head.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    some = bounds[:-1] < bounds[1:]
    first = bounds[:-1][some]
    begins[first] = head[first]
    tokens, points = _sums(begins, bounds), _sums(head, bounds)
    ends = np.tile(np.array([0, 1]), (len(some), 1))  # an empty row changes nothing
    ends[some] = letter[bounds[1:][some] - 1][:, None]
    counts = np.stack([tokens, tokens], 1)
    counts[some, 1] -= letter[first]  # from within a run, a first letter begins no token
    return ends, counts, points, begins


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def locate(begins: np.ndarray, cut: int) -> int:
    """Where the first `cut` tokens end, given where tokens begin."""
    starts = np.flatnonzero(begins)
    return int(starts[cut]) if cut < len(starts) else len(begins)


def assemble(text: bytes, form: str, a: int, b: int) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    if form == "spm":
        return b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text, from an output and its form alone: pieces have no sentinel, so the first of each divides them."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output[len(one) :].split(two.encode(), 1)
    second, middle = rest.split(MIDDLE.encode(), 1)
    return first + middle + second if form == "psm" else second + middle + first


def _draws(key: Column) -> list[Column]:
    code = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(code, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _form(text: Column, h3: Column, h4: Column) -> Column:
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(s))
    return F.when((text == "") | marked | (h3 % 100 >= PLAIN_FROM), "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")


def _short(docs: DataFrame) -> DataFrame:
    """Tokens and places of texts of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            data, offsets = string_buffers(texts)
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            _, counts, _, begins = scan(data, offsets)
            n = counts[:, 0]  # a text begins outside a run
            draws = [np.asarray(batch.column(c)) % (n + 1) for c in ("_h1", "_h2")]
            form = batch.column("_form").to_pylist()
            got = []
            for i, (a, b) in enumerate(zip(np.minimum(*draws).tolist(), np.maximum(*draws).tolist(), strict=True)):
                row = begins[offsets[i] : offsets[i + 1]]
                got.append(_results(data[offsets[i] : offsets[i + 1]].tobytes(), form[i], locate(row, a), locate(row, b)))
            yield _batch(batch, n, got)

    return arrow_map(docs, run, _schema(docs))


_RESULTS = ("prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")


def _results(text: bytes, form: str, a: int, b: int) -> tuple:
    output = assemble(text, form, a, b)
    hashes = hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()
    points = (None, None) if form == "plain" else (int(_HEAD[np.frombuffer(text[:a], np.uint8)].sum()), int(_HEAD[np.frombuffer(text[a:b], np.uint8)].sum()))
    return (*points, *hashes, output)


def _schema(docs: DataFrame) -> str:
    return f"_key {docs.schema['_key'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string, output string"


def _batch(batch: pa.RecordBatch, n: np.ndarray, got: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
    text = pa.array([g[4] for g in got], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int64()), batch.column("_form"), *cols, text], ["_key", "n", "form", *_RESULTS])


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc, chunk, piece, and what scan says of it) of texts of several chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("_doc"), batch.column("_text"), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                at = 0
                for chunk in range(len(raw)):
                    end = min(at + size, len(raw))
                    while end < len(raw) and not _HEAD[raw[end]]:  # chunks end between code points
                        end += 1
                    piece = raw[at:end]
                    ends, counts, points, _ = scan(piece, np.array([0, len(piece)]))
                    row = [[doc.as_py()], [chunk], [at], [ends[0].tolist()], [counts[0].tolist()], [int(points[0])], [piece.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _CHUNK_TYPES, strict=True)], _CHUNK_NAMES)
                    at = end
                    if at == len(raw):
                        break

    return arrow_map(docs.select("_doc", "_text"), run, "_doc bigint, chunk bigint, at bigint, ends array<int>, counts array<bigint>, points bigint, piece binary")


_CHUNK_NAMES = ["_doc", "chunk", "at", "ends", "counts", "points", "piece"]
_CHUNK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.binary()]


def _composed(parts: Column) -> Column:
    """Transition and counts of summaries one after the other: (f then g)(s) = g(f(s)), counts n_f(s) + n_g(f(s))."""
    start = F.struct(F.array(F.lit(0), F.lit(1)).alias("ends"), F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).alias("counts"))
    step = lambda acc, x: F.struct(
        F.transform(acc["ends"], lambda s: F.get(x["ends"], s)).alias("ends"),
        F.transform(acc["ends"], lambda s, i: F.get(acc["counts"], i) + F.get(x["counts"], s)).alias("counts"),
    )
    return F.aggregate(parts, start, step)


def _entries(parts: Column, state: Column, tokens: Column) -> Column:
    """For each summary in order, with where it is: the state and the number of tokens before it."""
    start = F.struct(state.alias("state"), tokens.alias("tokens"), F.array().cast("array<struct<no:bigint,state:int,before:bigint>>").alias("out"))
    step = lambda acc, x: F.struct(
        F.get(x["ends"], acc["state"]).alias("state"),
        (acc["tokens"] + F.get(x["counts"], acc["state"])).alias("tokens"),
        F.concat(acc["out"], F.array(F.struct(x["no"].alias("no"), acc["state"].alias("state"), acc["tokens"].alias("before")))).alias("out"),
    )
    return F.aggregate(parts, start, step)


def _long(docs: DataFrame, size: int, group: int) -> DataFrame:
    """The same of texts of several chunks, through their chunks."""
    chunks = stored(_chunks(docs, size))
    part = F.struct(F.col("chunk").alias("no"), "ends", "counts")
    groups = (
        chunks.groupBy("_doc", F.floor(F.col("chunk") / group).alias("group")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .withColumn("whole", _composed(F.col("parts")))
    )
    groups = stored(groups)
    heads = (
        groups.groupBy("_doc").agg(F.sort_array(F.collect_list(F.struct(F.col("group").alias("no"), F.col("whole.ends").alias("ends"), F.col("whole.counts").alias("counts")))).alias("parts"))
        .withColumn("walk", _entries(F.col("parts"), F.lit(0), F.lit(0).cast("bigint")))
        .join(docs.select("_doc", "_h1", "_h2"), "_doc")
        .select("_doc", F.col("walk.tokens").alias("n"), F.explode("walk.out").alias("head"), "_h1", "_h2")
    )
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    heads = stored(heads.select("_doc", "n", F.col("head.no").alias("group"), "head.state", "head.before", F.least(a, b).alias("cut_a"), F.greatest(a, b).alias("cut_b")))
    entries = (
        groups.join(heads, ["_doc", "group"])
        .withColumn("walk", _entries(F.col("parts"), F.col("state"), F.col("before")))
        .select("_doc", "cut_a", "cut_b", F.explode("walk.out").alias("e"))
        .select("_doc", "cut_a", "cut_b", F.col("e.no").alias("chunk"), F.col("e.state").alias("state"), F.col("e.before").alias("before"))
    )
    # a cut is in the chunk whose tokens reach it; those that a chunk begins with are in the one before unless it is the first
    inner = entries.join(chunks.select("_doc", "chunk", "counts", "at"), ["_doc", "chunk"]).withColumn("after", F.col("before") + F.get("counts", F.col("state")))
    wanted = inner.select("_doc", "chunk", "state", "before", F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col("cut_a").alias("cut")), F.struct(F.lit("b").alias("which"), F.col("cut_b").alias("cut")))).alias("w"), "after")
    wanted = wanted.where((F.col("w.cut") >= F.col("before")) & (F.col("w.cut") < F.col("after"))).select("_doc", "chunk", "state", "before", "w.which", "w.cut")
    found = arrow_map(chunks.select("_doc", "chunk", "at", "piece").join(wanted, ["_doc", "chunk"]), _search, "_doc bigint, which string, place bigint")
    places = found.groupBy("_doc").agg(F.max(F.when(F.col("which") == "a", F.col("place"))).alias("a"), F.max(F.when(F.col("which") == "b", F.col("place"))).alias("b"))
    whole = heads.groupBy("_doc").agg(F.first("n").alias("n")).join(places, "_doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                one = batch.slice(i, 1)
                text = one.column("_text")[0].as_buffer().to_pybytes()
                a, b = (one.column(c)[0].as_py() for c in ("a", "b"))  # none: at the end of the text
                yield _batch(one, np.asarray(one.column("n")), [_results(text, one.column("_form")[0].as_py(), len(text) if a is None else a, len(text) if b is None else b)])

    return arrow_map(docs.join(whole, "_doc"), run, _schema(docs))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte at which a cut's chunk has it, from the state that the chunk is entered in."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            piece = np.frombuffer(r["piece"], np.uint8)
            begins = scan(piece, np.array([0, len(piece)]))[3]
            if r["state"] and _LETTER[piece[0]]:
                begins[0] = False
            out.append(r["at"] + locate(begins, r["cut"] - r["before"]))
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("which"), pa.array(out, pa.int64())], ["_doc", "which", "place"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", size: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Per row: key, n, form, prefix_chars, middle_chars, output (the transformed text), output_sha256, restored_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col("_key"))
    own = docs.select(F.col(key).alias("_key"), text.alias("_text")).select("_key", "_text", h1.alias("_h1"), h2.alias("_h2"), _form(F.col("_text"), h3, h4).alias("_form"))
    length = F.octet_length("_text")
    out = _short(own.where(length <= size))
    long = stored(own.where(length > size).withColumn("_doc", F.monotonically_increasing_id()))  # written once, so ids stay
    if not long.isEmpty():
        out = out.unionByName(_long(long, size, group))
    return out.withColumnRenamed("_key", key)
