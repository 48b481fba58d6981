"""Total order without a single-task window.

``dense_index`` numbers the rows of a table 0..n-1 in a given total order with one range
shuffle. Running totals, running maxima and "previous row" then work on chunks of a fixed
number of rows, so that neither a busy owner nor a busy minute lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

INDEX = "_idx"
CHUNK_ROWS = 1 << 20


def dense_index(df: DataFrame, order: list[Column], name: str = INDEX, partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of every row in ``order`` (which must be a total order).

    Without a number of partitions, adaptive execution may merge neighbouring ranges.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut(
        spread.sortWithinPartitions(*order)
        # partition number in the upper bits, position within the partition in the lower 33
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: at most as many as there are shuffle partitions
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset", "_place")
    )


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null keys are equal, so that no row is lost."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def _chunked(df: DataFrame, index: str, rows: int) -> DataFrame:
    """A table that still has the chunks of the step before is not dealt out to them again."""
    return df if "_chunk" in df.columns else df.withColumn("_chunk", F.floor(F.col(index) / rows))


def running(
    df: DataFrame,
    value: Column,
    name: str,
    how: str = "sum",
    inclusive: bool = True,
    index: str = INDEX,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` along the dense index.

    Each chunk is scanned by itself; the chunk totals (one row per ``rows`` rows) are
    accumulated and joined back.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    last = 0 if inclusive else -1
    df = _chunked(df, index, rows).withColumn("_value", value)
    within = Window.partitionBy("_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, last)
    totals = df.groupBy("_chunk").agg(agg("_value").alias("_total"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_chunk", agg("_total").over(before).alias("_carried"))
    df = df.withColumn("_inner", agg("_value").over(within)).join(carried, "_chunk")
    if how == "sum":
        zero = F.lit(0)
        out = F.coalesce(F.col("_inner"), zero) + F.coalesce(F.col("_carried"), zero)
    else:
        out = F.greatest("_inner", "_carried")
    return df.withColumn(name, out).drop("_chunk", "_value", "_inner", "_carried")


def carried_last(
    df: DataFrame, value: Column, name: str, inclusive: bool = False, index: str = INDEX, rows: int = CHUNK_ROWS, chunks: bool = False
) -> DataFrame:
    """Last non-null ``value`` before (or up to) each row along the dense index.

    With ``chunks`` the column ``_chunk`` stays for a next step over the same index and ``rows``.
    """
    # structs compare by their first field, so the maximum is the latest one
    stamped = F.when(value.isNotNull(), F.struct(F.col(index).alias("at"), value.alias("value")))
    df = _chunked(df, index, rows).withColumn("_value", stamped)
    within = Window.partitionBy("_chunk").orderBy(index).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    totals = df.groupBy("_chunk").agg(F.max("_value").alias("_total"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_chunk", F.max("_total").over(before).alias("_carried"))
    df = df.withColumn("_inner", F.max("_value").over(within)).join(carried, "_chunk")
    out = df.withColumn(name, F.coalesce("_inner", "_carried")["value"]).drop("_value", "_inner", "_carried")
    return out if chunks else out.drop("_chunk")


def next_on_or_after(left: DataFrame, right: DataFrame, left_time: str, right_time: str, name: str, key: str) -> DataFrame:
    """Add the smallest ``right_time`` that is not before ``left_time`` (null when there is none).

    Both sides are merged in one descending order; each left row takes the last right value
    above it. ``key`` is unique in ``left``.
    """
    marks = right.select(F.col(right_time).alias("_t")).where("_t is not null").distinct()
    both = left.select(F.col(left_time).alias("_t"), F.col(key).alias("_key"), F.lit(1).alias("_side")).unionByName(
        marks.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    rows = dense_index(both, [F.col("_t").desc(), F.col("_side").asc(), F.col("_key").asc()])
    rows = carried_last(rows, F.when(F.col("_side") == 0, F.col("_t")), name)
    return left.join(rows.where("_side = 1").select(F.col("_key").alias(key), name), key)
