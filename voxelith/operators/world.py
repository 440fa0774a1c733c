"""Block worlds: layout, chunks and sections, packed indices, comparison of two worlds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.grid import canonical_order, chunk, local_index, region

#: Words in the names of blocks that cannot be stood on.
NOT_SOLID = ("air", "water", "lava", "glass_pane", "torch", "sapling", "carpet", "button", "sign", "rail")


def layout(blocks: DataFrame, margin: int = 8, platform_y: int = 64) -> DataFrame:
    """One row: how far blocks are moved so that the least x and z are 0 and the lowest stands on the platform, the
    platform's rectangle, and where to appear."""
    b = blocks.agg(*(f(n).alias(f"{k}_{n}") for n in ("x", "y", "z") for k, f in (("min", F.min), ("max", F.max))))
    w = b.withColumns({"width": F.col("max_x") - F.col("min_x") + 1, "depth": F.col("max_z") - F.col("min_z") + 1})
    return w.select(
        (-F.col("min_x")).alias("shift_x"), (platform_y + 1 - F.col("min_y")).alias("shift_y"), (-F.col("min_z")).alias("shift_z"), "width", "depth",
        F.lit(-margin).alias("platform_min"), (F.col("width") - 1 + margin).alias("platform_max_x"), (F.col("depth") - 1 + margin).alias("platform_max_z"),
        F.expr("(width - 1) div 2").alias("spawn_x"), F.lit(-margin + max(1, margin // 2)).alias("spawn_z"),
    )


def centring(df: DataFrame) -> DataFrame:
    """One row: minus the middle of the bounds, halves to even."""
    return df.agg(*((-F.rint((F.min(n) + F.max(n)) / 2)).cast("int").alias(f"t_{n}") for n in ("ix", "iz")), (-F.min("iy")).alias("t_iy"))


def platform(spark, x0: int, x1: int, z0: int, z1: int, y: int, state: str) -> DataFrame:
    """The platform's blocks; generated in parallel, never on the driver."""
    xs = spark.range(x0, x1 + 1).select(F.col("id").cast("int").alias("x"), F.lit(y).alias("y"))
    return xs.withColumn("z", F.explode(F.sequence(F.lit(z0), F.lit(z1)))).withColumn("state", F.lit(state))


def state_name(state: Column) -> Column:
    return F.split_part(state, F.lit("["), F.lit(1))


def state_properties(state: Column) -> Column:
    """Sorted "key=value" pairs of "name[key=value,...]"; empty without properties."""
    inner = F.regexp_extract(state, r"\[(.*)\]$", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.split(inner, ",")))


def solid(state: Column) -> Column:
    return ~state_name(state).rlike("|".join(NOT_SOLID))


def sections(blocks: DataFrame, always_air: bool = False) -> DataFrame:
    """(cx, cz, sy, blocks, palette): each 16x16x16 section's sorted distinct states (air too, unless it is full; always_air: even then)."""
    s = blocks.select(chunk(F.col("x")).alias("cx"), chunk(F.col("z")).alias("cz"), chunk(F.col("y")).alias("sy"), "state")
    out = s.groupBy("cx", "cz", "sy").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_set("state")).alias("palette"))
    return out.withColumn("palette", F.when((F.col("blocks") < 4096) | F.lit(always_air), F.array_sort(F.array_union("palette", F.array(F.lit("minecraft:air"))))).otherwise(F.col("palette")))


def bits_for(states: Column) -> Column:
    return F.greatest(F.lit(4), F.ceil(F.log2(states) - 1e-12)).cast("int")


def packed_words(blocks: DataFrame, palettes: DataFrame) -> DataFrame:
    """(cx, cz, sy, word, value): palette indices packed into 64-bit words, no index across two words.
    Places without a block are air."""
    at = local_index(F.col("x"), F.col("y"), F.col("z"))
    b = blocks.select(chunk(F.col("x")).alias("cx"), chunk(F.col("z")).alias("cz"), chunk(F.col("y")).alias("sy"), at.alias("at"), "state")
    places = palettes.where(F.size("palette") > 1).select("cx", "cz", "sy", "palette", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("at"))
    j = places.join(b, ["cx", "cz", "sy", "at"], "left").withColumn("state", F.coalesce("state", F.lit("minecraft:air")))
    j = j.withColumns({"bits": bits_for(F.size("palette")), "index": F.array_position("palette", F.col("state")).cast("bigint") - 1})
    per = F.floor(F.lit(64) / F.col("bits")).cast("int")
    j = j.withColumns({"word": F.floor(F.col("at") / per).cast("int"), "shift": (F.pmod(F.col("at"), per) * F.col("bits")).cast("int")})
    return j.groupBy("cx", "cz", "sy", "word").agg(F.bit_or(F.expr("shiftleft(index, shift)")).alias("value"))


def unpack(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, state): words (array of 64-bit) and palette back to 4096 states; a section without words has one state."""
    bits = bits_for(F.size("palette"))
    per = F.floor(F.lit(64) / F.col("bits")).cast("int")
    df = words.withColumn("bits", bits).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(4095))))
    word = F.get(F.col("words"), F.floor(F.col("at") / per).cast("int"))
    index = F.when(F.size("palette") == 1, F.lit(0).cast("bigint")).otherwise(F.expr("shiftrightunsigned(_w, cast(pmod(at, cast(floor(64 / bits) as int)) * bits as int)) & (shiftleft(1L, bits) - 1)"))
    return df.withColumn("_w", word).select(*keys, "at", F.get("palette", index.cast("int")).alias("state"))


def heights(blocks: DataFrame, min_y: int = -64) -> DataFrame:
    """Per column, the first free height counted from the world's floor."""
    return blocks.groupBy("x", "z").agg((F.max("y") + 1 - min_y).alias("height"))


def compare(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("x", "y", "z"), value: str = "state") -> DataFrame:
    """Differences of two worlds: wrong state, missing, unexpected."""
    e, a = expected.select(*keys, F.col(value).alias("expected")), actual.select(*keys, F.col(value).alias("actual"))
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("mismatch")
    return e.join(a, list(keys), "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("difference", kind)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def chunk_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(region(F.col("x")).alias("rx"), region(F.col("z")).alias("rz"), chunk(F.col("x")).alias("cx"), chunk(F.col("z")).alias("cz")).agg(
        F.count("*").alias("blocks"), F.count_distinct(chunk(F.col("y"))).alias("sections"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def in_order(blocks: DataFrame) -> DataFrame:
    return blocks.orderBy(*canonical_order())
