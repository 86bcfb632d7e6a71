"""Global numbering of rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int | Column = 1) -> DataFrame:
    """Adds consecutive numbers in the given order (which should end in a unique column).

    Rows are range-partitioned and sorted; each partition's first number comes from the counts of
    the ones before it. The sorted rows are written to the shared folder, so counting and numbering
    see the same partitions even if executors are lost in between. Equal keys share a partition only when the
    whole order is equal, so a value held by a third of the rows is still spread.
    """
    position = F.monotonically_increasing_id()
    ranged = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", position))
    part = F.shiftright("_at", _ROW_BITS)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition, so this window and the broadcast are bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    at_row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    start = F.lit(start) if isinstance(start, int) else start
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + at_row + start).cast("bigint"))
        .drop("_at", "_part", "_offset")
    )
