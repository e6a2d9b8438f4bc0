"""Row numbers, batch numbers and running totals without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.errors import ConfigError
from rowferry.scratch import materialize

_PART_BITS = 33  # monotonically_increasing_id keeps the position in the low bits


def with_row_no(
    df: DataFrame, order_by: list[str], first: int = 1, name: str = "row_no"
) -> DataFrame:
    """Consecutive numbers in the order of ``order_by`` (a unique key), starting at ``first``.

    Rows are range-partitioned and sorted, and their position in the partition
    is written with them: a later read sees the positions of this one sort, not
    of a second one with other range bounds. The start of each partition comes
    from one count per partition; that table has as many rows as the sort had
    partitions.
    """
    if not order_by:
        raise ConfigError("row numbers need order_by: a frame has no order of its own")
    placed = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    return number_positions(materialize(placed, "numbered"), first, name)


def number_positions(placed: DataFrame, first: int, name: str) -> DataFrame:
    """Replace stored ``__pos`` ids by consecutive numbers."""
    part = F.shiftright("__pos", _PART_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per sorted partition: small enough to be summed up in one window.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = F.col("__pos").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.select(
        (F.col("__start") + inside + F.lit(first)).cast("bigint").alias(name),
        *[c for c in placed.columns if c != "__pos"],
    )


def batch_no(row_no: Column, first: int, batch_size: int) -> Column:
    """Zero-based batch of a row number."""
    return F.floor((row_no - F.lit(first)) / F.lit(max(batch_size, 1))).cast("bigint")


def running_totals(
    df: DataFrame, order: str, sums: list[str], block: int = 4096
) -> DataFrame:
    """Add ``<name>_before``: the sum of all earlier rows, for a dense integer ``order``.

    Two levels: totals per block of ``block`` consecutive rows, summed up over
    the (block times fewer) blocks, then windows inside each block. No window
    sees more than one block or one row per block.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    totals = blocked.groupBy("__block").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__block",
        *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__s_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocked.join(starts, "__block").select(
        *df.columns,
        *[
            (F.col(f"__s_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
            .cast("bigint")
            .alias(f"{s}_before")
            for s in sums
        ],
    )
