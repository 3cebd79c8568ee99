"""Consecutive row numbers without pulling the table into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photarium.session import settle

# Layout of monotonically_increasing_id: partition number above, row offset below.
_OFFSET_BITS = 33


def number_rows(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """Add ``name`` = ``start`` + 1, + 2, ... in the order of ``order``.

    ``order`` must be unique, so that no value spans range partitions. Rows are range
    partitioned and sorted, which leaves each row's place inside its partition; adding the
    number of rows in the partitions before gives the global place. The range boundaries
    come from a sample and may differ between runs of the same plan, so the placed rows
    are written once and both steps read that copy, the counting one only its place
    column. The offsets table holds one row per partition, which bounds what is broadcast.
    """
    placed = settle(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    partition = F.shiftright("_place", _OFFSET_BITS).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(partition).agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    row_in_partition = F.col("_place").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    return (
        placed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.lit(start + 1) + F.col("_before") + row_in_partition).cast("long"))
        .drop("_place", "_part", "_before")
    )


def largest(df: DataFrame, column: str) -> int:
    """Largest value of ``column``, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]
