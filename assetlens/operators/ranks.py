"""Row numbers over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.session import staged


def with_row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with their number, from 0, in ascending order of `order` (unique together).

    Rows are dealt out by ranges of the key and numbered within each task; what stands before a
    task's rows is a sum over one count per task.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(dealt.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("task", F.shiftrightunsigned("at", 33))
    counts = placed.groupBy("task").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at")
    offsets = counts.select("task", shift.alias("shift"))
    return placed.join(offsets, "task").select(*rows.columns, (F.col("at") + F.col("shift")).alias(name))
