"""Stable row numbers without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw

SLOTS = 4096


def number_rows(df: DataFrame, key: str, output: str = "row_index", slots: int = SLOTS) -> DataFrame:
    """Add 0-based numbers that depend on the unique ``key`` alone.

    Keys are hashed into slots and numbered inside their slot; the offsets of the slots come from
    their counts, at most ``slots`` rows. No task sees more than one slot's share of the rows.
    """
    slotted = df.withColumn("_slot", draw(F.col(key), slots).cast("int"))
    counts = slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("_count"))
    before = F.sum("_count").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_slot", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_slot").orderBy(key)) - 1
    return (
        slotted.withColumn("_n", inside)
        .join(F.broadcast(offsets), "_slot")
        .withColumn(output, F.col("_offset") + F.col("_n"))
        .drop("_slot", "_n", "_offset")
    )
