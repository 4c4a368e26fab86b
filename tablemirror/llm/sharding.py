"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash is the one published by Lamping and Veach (2014): a 64-bit linear congruential
generator seeded with the key draws the shard counts at which the key moves, so no ring
table is needed and an appended shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tablemirror.llm.common import id_bounds, range_of, replaced

#: Fixed value: the published generator's multiplier; its increment is 1.
_MULTIPLIER = 2862933555777941757
#: A key draws about ln(n) times; more than 128 draws has a chance under 1e-40 for any
#: count of shards up to 2**31, and the last draw would then still be a valid shard.
_MOST_DRAWS = 128


def _low_word(x: Column, factor: int) -> Column:
    """A number below 2**49 that equals ``x * factor`` modulo 2**32, for x, factor < 2**32."""
    return x * F.lit(factor & 0xFFFF) + F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)


def _next_key(k: Column) -> Column:
    """``k * multiplier + 1`` modulo 2**64 in products that stay below 2**50.

    ANSI mode refuses an overflowing bigint product, so the factors are cut into 32- and
    16-bit parts and put together with bit operations, which wrap.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    low, high = _MULTIPLIER & 0xFFFFFFFF, _MULTIPLIER >> 32
    a, b = k.bitwiseAND(mask), F.shiftrightunsigned(k, 32)
    first = _low_word(a, low) + 1
    carry = F.shiftright(first, 32) + F.shiftright(a * F.lit(low >> 16), 16)
    upper = carry + _low_word(a, high) + _low_word(b, low)
    return F.shiftleft(upper.bitwiseAND(mask), 32).bitwiseOR(first.bitwiseAND(mask))


def jump_shards(key: Column, n_shards: int) -> Column:
    """Struct ``(shard, grown)``: the shard of a bigint key among ``n_shards``, and among one more.

    One run of the generator serves both counts, because the draws do not depend on them.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    zero = F.lit(0).cast("long")
    start = F.struct(_next_key(key).alias("k"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))

    def draw(s: Column, _: Column) -> Column:
        jump = (s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftrightunsigned(s["k"], 33) + 1))
        moved = F.struct(
            _next_key(s["k"]).alias("k"),
            F.floor(jump).cast("long").alias("j"),
            F.when(s["j"] < n_shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
        )
        return F.when(s["j"] > n_shards, s).otherwise(moved)

    draws = F.sequence(F.lit(1), F.lit(min(n_shards + 1, _MOST_DRAWS)))
    return F.aggregate(
        draws, start, draw, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))
    )


def shard_key(df: DataFrame, key: str) -> Column:
    """The bigint that seeds the generator: the value of an integer key, a 64-bit hash of any other; null counts as 0."""
    column = F.col(f"`{key}`")
    if isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(column.cast("long"), F.lit(0).cast("long"))
    return F.when(column.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(column))


def assign_shards(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard if there were one more) to every row.

    A pure map: no shuffle, and the result for a row depends on its key and the count
    only. Rows with a null key go where key 0 goes. Columns of the same names are replaced.
    """
    return (
        replaced(df, "shard", "grown_shard")
        .withColumn("__jump", jump_shards(shard_key(df, key), n_shards))
        .withColumns({"shard": F.col("__jump.shard"), "grown_shard": F.col("__jump.grown")})
        .drop("__jump")
    )


def number_slots(df: DataFrame, key: str, rows_per_range: int = 20_000) -> DataFrame:
    """Add ``slot``: the place of a row in its shard in ascending key order, gapless from 0.

    A shard may hold any number of rows, so no task numbers a whole one. Rows are numbered
    inside (shard, key range) blocks, and the blocks' counts, at most 256 a shard, are
    summed up before. Null keys come first; rows with equal keys take adjacent slots in
    no set order. Needs an integer key and a column ``shard``.
    """
    ranged = replaced(df, "slot", "__range").withColumn(
        "__range", range_of(F.col(f"`{key}`"), id_bounds(df, key, rows_per_range))
    )
    counts = ranged.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__range").orderBy(F.col(f"`{key}`").asc_nulls_first())
    return (
        ranged.withColumn("__row", F.row_number().over(inside))
        .join(starts, ["shard", "__range"])
        .withColumn("slot", (F.col("__start") + F.col("__row") - 1).cast("long"))
        .drop("__range", "__row", "__start")
    )
