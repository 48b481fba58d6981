"""Joins of points and ranges on dyadic buckets.

A range of whole numbers (days) is cut into the largest aligned blocks of 1, 2, 4, ... numbers: at most two
per level, so a window of 30 years is some 20 rows instead of 11,000. A point lies in one block per level,
and in exactly one block of each range that holds it. The join is an equi join on (level, block), each pair
meets once, and a point is only looked up on the levels that some range uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2**22 days are longer than the calendar
LEVELS = 22


def day_number(c: Column) -> Column:
    return F.unix_date(c.cast("date")).cast("bigint")


def _block(level: Column, block: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), block.cast("bigint").alias("block"))


def range_blocks(low: Column, high: Column) -> Column:
    """The blocks (level, block) that make up low..high; none where high is below low."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    start = F.struct(low.cast("bigint").alias("l"), (high.cast("bigint") + 1).alias("r"), none.alias("blocks"))

    def odd(x: Column) -> Column:
        return x.bitwiseAND(F.lit(1).cast("bigint")) == 1

    def step(acc: Column, level: Column) -> Column:
        l, r = acc["l"], acc["r"]
        left, right = (l < r) & odd(l), (l < r) & odd(r)
        blocks = F.concat(
            acc["blocks"],
            F.when(left, F.array(_block(level, l))).otherwise(none),
            F.when(right, F.array(_block(level, r - 1))).otherwise(none),
        )
        return F.struct(
            F.shiftright(l + left.cast("bigint"), 1).alias("l"), F.shiftright(r - right.cast("bigint"), 1).alias("r"), blocks.alias("blocks")
        )

    def rest(acc: Column) -> Column:
        # longer than the levels reach: as many blocks of the top level as it takes
        top = F.transform(F.sequence(acc["l"], acc["r"] - 1), lambda x: _block(F.lit(LEVELS), x))
        return F.when(acc["l"] < acc["r"], F.concat(acc["blocks"], top)).otherwise(acc["blocks"])

    return F.when(low <= high, F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, rest)).otherwise(none)


def used_levels(blocks: DataFrame, level: str = "_level") -> list[int]:
    """The levels that occur: 23 at most, so the list is short whatever the table."""
    return sorted(r[0] for r in blocks.select(level).distinct().collect())


def point_blocks(point: Column, levels: list[int]) -> Column:
    """The block of ``point`` on each of ``levels``."""
    point = point.cast("bigint")
    return F.array(*[_block(F.lit(n), F.shiftright(point, n)) for n in levels]).cast("array<struct<level:int,block:bigint>>")


def blocked_ranges(ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    """``ranges`` with a row per block: ``_level``, ``_block``."""
    return ranges.withColumn("_b", F.explode(range_blocks(low, high))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")


def blocked_points(points: DataFrame, point: Column, levels: list[int]) -> DataFrame:
    return points.withColumn("_b", F.explode(point_blocks(point, levels))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")


def points_in_ranges(points: DataFrame, point: Column, ranges: DataFrame, low: Column, high: Column, by: list[str] | None = None) -> DataFrame:
    """Every point with every range low..high (whole numbers, ends included) that holds it, each pair once.

    Columns of both sides stay, so other names than ``by`` must differ; null owners are equal.
    """
    right = blocked_ranges(ranges, low, high)
    left = blocked_points(points, point, used_levels(right))
    named = right.withColumnsRenamed({c: f"_r{c}" for c in ("_level", "_block", *(by or []))})
    on = (F.col("_level") == F.col("_r_level")) & (F.col("_block") == F.col("_r_block"))
    for c in by or []:
        on = on & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return left.join(named, on).drop("_level", "_block", *[f"_r{c}" for c in ("_level", "_block", *(by or []))])
