"""Hot keys: same rows, spread over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetlens import Register
from assetlens.operators import quality
from assetlens.operators.skew import semi_join_sliced


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share a tag, many of them alike in all columns."""
    return spark.range(0, 9000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
        .otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
        .alias("Asset Tag"),
        (F.col("id") % 2).cast("string").alias("Model"),
        F.when(F.col("id") % 7 != 0, F.lit("s")).alias("Serial Number"),
    )


@pytest.mark.parametrize("rows_per_slice", [10, 100, 1_000_000])
@pytest.mark.parametrize("role", ["asset_tag", "serial_number"])
def test_rows_are_whole(hot, role, rows_per_slice):
    register = Register.of(hot)
    shown = quality.duplicate_rows(register, role, rows_per_slice)
    column = register.roles[role]
    rows = [r.asDict() for r in register.df.collect()]
    count = Counter(r[column] for r in rows if r[column] is not None)
    expected = Counter(
        tuple(r[c] for c in shown.columns) for r in rows if count.get(r[column], 0) > 1
    )
    found = [tuple(r) for r in shown.collect()]
    assert Counter(found) == expected
    keys = [r[0] for r in found]
    assert keys == sorted(keys)


def test_copies_are_spread(hot):
    rows = Register.of(hot).df.select("asset_tag", "model")
    counted = rows.groupBy("asset_tag").agg(F.count("*").alias("n")).where("n > 1")
    joined = semi_join_sliced(rows, counted, "asset_tag", rows_per_slice=300)
    sizes = {
        r["slice"]: r["n"]
        for r in joined.where("asset_tag = 'hot'")
        .groupBy("slice")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    assert sum(sizes.values()) == 3000
    assert len(sizes) == 10 and max(sizes.values()) <= 1000
    # Cold keys are left in one slice.
    assert joined.where("asset_tag like 't%' and slice > 0").count() == 0


def test_every_hot_key_is_split(spark):
    from pyspark.sql import functions as F

    from assetlens.operators.skew import semi_join_sliced

    keys = 10_500
    rows = spark.range(keys * 6).select((F.col("id") % keys).cast("string").alias("k"), "id")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = semi_join_sliced(rows, counted, "k", rows_per_slice=2)
    slices = found.groupBy("k").agg(F.countDistinct("slice").alias("s"), F.count("*").alias("n"))
    assert slices.where("n = 6 AND s > 1").count() > 0.95 * keys and found.count() == keys * 6
