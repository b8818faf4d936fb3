"""A semi join on a key that a large part of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000


def semi_join_sliced(
    rows: DataFrame,
    counted: DataFrame,
    key: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Rows whose `key` is in `counted(key, n)`, plus a `slice` column.

    Keys with more than `rows_per_slice` rows are spread over n / rows_per_slice slices, however
    many such keys there are; there is at most one per `rows_per_slice` rows. Spark's own size
    check decides how the list of them is joined.

    The slice of a row depends on its content and on its partition, both of which a repeated
    task finds again, so that copies of one row are spread too.
    """
    hot = (
        counted.where(F.col("n") > rows_per_slice)
        .groupBy(F.xxhash64(key).alias("hot_hash"))
        .agg(F.ceil(F.max("n") / rows_per_slice).cast("int").alias("slices"))
    )

    def with_slices(df: DataFrame) -> DataFrame:
        return df.join(hot, F.xxhash64(key) == F.col("hot_hash"), "left").drop("hot_hash")

    # The hash is cut down first: added to a partition number in full it could overflow.
    content = F.pmod(F.xxhash64(*rows.columns), F.col("slices"))
    spread = F.pmod(content + F.spark_partition_id(), F.col("slices"))
    left = (
        with_slices(rows)
        .withColumn(
            "slice", F.when(F.col("slices").isNull(), 0).otherwise(spread).cast("int")
        )
        .drop("slices")
    )
    right = with_slices(counted.select(key, "n")).select(
        key, F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice")
    )
    return left.join(right, [key, "slice"], "left_semi")
