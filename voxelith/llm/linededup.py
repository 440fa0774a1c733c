"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line with at least one word is the set of its distinct words.  Two lines match if the Jaccard similarity of their sets is
at least ``percent`` hundredths; a line goes if a line before it (smaller doc_id, or earlier in the same document) matches it.

1. One pass counts words in a table of BUCKETS hash buckets (the driver sees that table only, whatever the corpus).
   A line's words are ordered by rarity: the logarithm of the bucket's count, in thirds, then hash.
2. Equal sets are one class with its first line; the other lines of the class go.
3. Firsts of classes are joined on the words of their prefixes.  A prefix has need(size) words more than the size less the least
   number of shared words, so the prefixes of a pair share as many words as the lesser need of the two: one for short lines,
   two for those of LONG words or more, where a single shared rare word is mostly chance.  The positional filter counts the
   words before a shared one that cannot be shared, and what the rest of the sets differ by; the length filter and one on
   128-bit maps of the sets, whose bits differ in no more places than the sets do, stand in the join condition too.
4. First, where more than CROWD lines share one of their STAR last prefix words, each is tried against the line of the
   largest class among them.  Where many more share one of the WIDE last, those without a match are then tried against such a line
   of each of HEADS parts (by hash), so that groups of near copies do not grow with their square: a line that is like a
   tenth of the earlier ones of its group nearly always finds one of these.  Only lines without a match there are then tried against
   all earlier lines that share prefix words.
5. Candidates are verified on their whole sets.

Null or empty texts have no lines with words.  Rows of null doc_id take no part.  Rows that repeat a doc_id count as one
document: their lines go by number.  Empty tables give no rows.  Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.graph import sized
from voxelith.llm.quality import let
from voxelith.llm.store import drop, release, stored

BUCKETS = 1 << 18
SIMILARITY_PERCENT = 80
LONG = 32
STAR, CROWD = 2, 8
#: Prefix words, and parts of the lines that share one, for the second trial.
WIDE, HEADS = 6, 32
#: Parts of the keys that are joined one after the other, so that disk holds one part's rows at a time.
PARTS = 3
_SPACES = r"[\x20\x09-\x0D]+"
_HASH_BITS = 56


def _hashes(t: Column) -> Column:
    """Hashes of a line's distinct words.  Only lines that hold white space other than blanks need the pattern."""
    others = t.contains("\t") | t.contains("\x0b") | t.contains("\x0c") | t.contains("\r")
    words = F.when(others, F.split(t, _SPACES)).otherwise(F.split(t, " "))
    return F.array_distinct(F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def word_levels(docs: DataFrame, text: str = "text") -> Column:
    """A constant array of bytes: by hash bucket, the logarithm of its words' count, in thirds."""
    words = docs.select(F.explode(F.split(text, _SPACES)).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
    level = [0] * BUCKETS
    for bucket, n in counts:
        level[bucket] = min(127, int(3 * math.log2(n)))
    return F.split(F.lit(",".join(map(str, level))), ",").cast("array<tinyint>")


def keyed_lines(docs: DataFrame, levels: Column, percent: int, key: str, text: str) -> DataFrame:
    """(id, line, s1, s2, size, map, prefix) of every line; s1 and s2 name its set; lines without words have size 0."""
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    low, bucket = F.lit((1 << _HASH_BITS) - 1), F.lit(BUCKETS - 1)
    ranked = lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(bucket).cast("int")).cast("bigint"), _HASH_BITS).bitwiseOR(h.bitwiseAND(low))
    df = lines.select("id", "line", F.sort_array(F.transform(_hashes(F.col("t")), ranked)).alias("k"))
    size = F.size("k")
    return df.select(
        "id", "line", F.xxhash64("k").alias("s1"), F.xxhash64(F.lit(1), "k").alias("s2"), size.alias("size"),
        F.struct(*(F.expr(f"aggregate(k, 0L, (a, x) -> if(x & 64 = {half}, a | shiftleft(1L, cast(x & 63 as int)), a))") for half in (0, 64))).alias("map"),
        F.slice("k", F.lit(1), (size - F.ceil(size * F.lit(percent) / 100) + _need(size)).cast("int")).alias("prefix"),
    )


def _need(size: Column) -> Column:
    return F.when(size >= LONG, F.lit(2)).otherwise(F.lit(1))


def _alike(percent: int) -> Column:
    """Length and map filters for sets of sizes na, nb and maps ma, mb."""
    na, nb, ma, mb = (F.col(c) for c in ("na", "nb", "ma", "mb"))
    apart = F.bit_count(ma["col1"].bitwiseXOR(mb["col1"])) + F.bit_count(ma["col2"].bitwiseXOR(mb["col2"]))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _may_match(percent: int) -> Column:
    """Also the positional filter for a shared word at places pa, pb, if it is one of the first that the two share."""
    na, nb, pa, pb = (F.col(c) for c in ("na", "nb", "pa", "pb"))
    before = pa + pb - 2 * (_need(F.least(na, nb)) - 1)  # of these words, need - 1 may be shared
    apart = before + F.abs((na - pa) - (nb - pb))
    return _alike(percent) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """Stored lines b of stored pairs (a, b) of lines (structs of id, line) whose word sets are similar enough."""
    wanted = stored(pairs.select(F.col("a.id"), F.col("a.line")).union(pairs.select(F.col("b.id"), F.col("b.line"))).distinct())
    ids = stored(wanted.select(F.col("id").alias(key)).distinct())
    owners = docs.join(sized(ids), key, "left_semi")
    lines = owners.select(F.col(key).alias("id"), F.posexplode(F.split(text, "\n")).alias("line", "t")).join(sized(wanted), ["id", "line"], "left_semi")
    sets = stored(lines.select(F.struct("id", "line").alias("x"), _hashes(F.col("t")).alias("w")))
    both = pairs.join(sets.select(F.col("x").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("x").alias("b"), F.col("w").alias("wb")), "b")
    similar = both.select("b", "wa", "wb", F.size(F.array_intersect("wa", "wb")).alias("n")).where(100 * F.col("n") >= percent * (F.size("wa") + F.size("wb") - F.col("n")))
    out = stored(similar.select("b").distinct())
    drop(wanted), drop(ids), drop(sets)
    release(docs.sparkSession)
    return out


def removed_lines(docs: DataFrame, percent: int = SIMILARITY_PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (id, line), lines counting from 0, of the lines that an earlier line matches."""
    docs = docs.select(key, text)
    lines = stored(keyed_lines(docs, word_levels(docs, text), percent, key, text))
    first = F.min(F.struct("id", "line", "size", "map", "prefix")).alias("f")
    firsts = stored(lines.where("size > 0").groupBy("s1", "s2").agg(first, F.count("*").alias("n")).select("s1", "s2", "n", "f.*"))
    again = stored(firsts.where("n > 1").select("s1", "s2", F.col("id").alias("fid"), F.col("line").alias("fline")))
    copies = stored(lines.join(sized(again), ["s1", "s2"]).where("id <> fid or line <> fline").select("id", "line").distinct())
    drop(lines), drop(again)
    release(docs.sparkSession)

    stars, found = [], None
    for last, parts, crowd in ((STAR, 1, CROWD), (WIDE, HEADS, 4 * HEADS)):
        tried = F.slice("prefix", F.greatest(F.lit(1), F.size("prefix") - (last - 1)), last)
        rows = firsts.select(F.explode(tried).alias("key"), F.struct("id", "line").alias("b"), F.col("size").alias("nb"), F.col("map").alias("mb"), "n")
        crowds = stored(rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > crowd).select("key"))
        open_ = rows = stored(rows.join(sized(crowds), "key", "left_semi"))
        if found is not None:
            open_ = stored(open_.join(sized(found), "b", "left_anti"))
        heads = rows.groupBy("key", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part")).agg(F.min(F.struct(-F.col("n"), "b", "nb", "mb")).alias("h"))
        heads = stored(heads.select("key", F.col("h.b").alias("a"), F.col("h.nb").alias("na"), F.col("h.mb").alias("ma")))
        stars.append(stored(open_.join(sized(heads), "key").where("a < b").where(_alike(percent)).select("a", "b").distinct()))
        done = _verified(stars[-1], docs, percent, key, text)
        found = done if found is None else stored(found.union(done).distinct())
        drop(crowds), drop(heads), drop(rows), drop(open_)
        release(docs.sparkSession)
    matched, star = found, stored(_union(stars).distinct())

    open_ = firsts.join(sized(matched).select("b.*", F.lit(True).alias("done")), ["id", "line"], "left")
    rest = []
    for part in range(PARTS):
        rows = open_.select("id", "line", "size", "map", F.col("done").isNull().alias("open"), F.posexplode("prefix").alias("place", "key"))
        rows = rows.where(F.pmod("key", F.lit(PARTS)) == part)
        # both sides are the same rows, so that one exchange serves them: what concerns one side alone refers to both
        a = rows.toDF("ia", "la", "na", "ma", "oa", "pa", "key")
        b = rows.toDF("ib", "lb", "nb", "mb", "ob", "pb", "key")
        earlier = F.when(F.col("ia") == F.col("ib"), F.col("la") < F.col("lb")).otherwise(F.col("ia") < F.col("ib"))
        pairs = a.join(b, "key").where(F.when(earlier, F.col("ob")).otherwise(F.lit(False))).where(_may_match(percent))
        pairs = pairs.groupBy("ia", "la", "ib", "lb").agg(F.count("*").alias("n"), F.min(_need(F.least("na", "nb"))).alias("need"))
        rest.append(stored(pairs.select(F.struct(F.col("ia").alias("id"), F.col("la").alias("line")).alias("a"), F.struct(F.col("ib").alias("id"), F.col("lb").alias("line")).alias("b"), "n", "need")))
        release(docs.sparkSession)
    found = _union(rest).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    left = stored(found.join(star, ["a", "b"], "left_anti"))
    late = _verified(left, docs, percent, key, text)
    out = stored(matched.union(late).select("b.*").union(copies).distinct())
    for x in (*stars, *rest, star, left, firsts, matched, late, copies):
        drop(x)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def dedup_lines(docs: DataFrame, percent: int = SIMILARITY_PERCENT, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the remaining lines as their text, and n_lines, n_removed_lines.  A null text stays null."""
    gone = removed_lines(docs, percent, key, text)
    by_doc = stored(gone.groupBy(F.col("id").alias(key)).agg(F.collect_set("line").alias("_gone")))
    joined = docs.join(sized(by_doc), key, "left")
    gone_here = lambda s: F.array_intersect(F.sequence(F.lit(0), F.size(s) - 1), F.coalesce(F.col("_gone"), F.array().cast("array<int>")))
    left = lambda s, g: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), g), lambda i: F.get(s, i)), "\n")
    cut = let(F.split(text, "\n"), lambda s: let(gone_here(s), lambda g: F.struct(F.size(s).alias("n"), F.size(g).alias("gone"), left(s, g).alias("t"))))
    whole = F.struct((F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).alias("n"), F.lit(0).alias("gone"), F.col(text).alias("t"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("gone"), F.lit(None).cast("string").alias("t"))
    new = F.when(F.col(text).isNull(), none).when(F.col("_gone").isNull(), whole).otherwise(cut)
    new_names = {"n_lines": "n", "n_removed_lines": "gone", text: "t"}
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    joined = joined.select(F.struct(*names).alias("_row"), new.alias("_new"))
    out = joined.select(*(F.col("_row")[c].alias(c) for c in names if c != text), *(F.col("_new")[v].cast("string" if v == "t" else "long").alias(c) for c, v in new_names.items()))
    if length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*names, "n_lines", "n_removed_lines")
