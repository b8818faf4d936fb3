"""The date format of each register, elected from its own values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.dates import iso_date, patterned_date
from assetlens.operators.headers import KEYS, ROWS_PER_SLICE

#: The name of the format that `iso_date` reads; all others are Spark date patterns.
ISO = "ISO"
#: Formats that registers are tried with, in order of preference.
FORMATS = [ISO, "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "dd MMM yyyy", "MMM dd, yyyy"]


def read_as(text: Column, name: str) -> Column:
    """The date that `text` has in one format, or NULL."""
    return iso_date(text) if name == ISO else patterned_date(text, name)


def elected_formats(rows: DataFrame, value: str, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Per register of `rows` (path, sheet, pos, and a column `value`): keys, date_format, n_values, n_read, last_pos.

    The register's first present value decides, as in a spreadsheet load: a format that reads it goes before
    all that do not. Of several that do, as of none, the one that reads the most values wins, then
    the one listed first. A register without values, or with none that any format reads, has no format. All is
    one aggregate with a fixed number of counters per register and task.
    """
    text = F.col(value).cast("string")
    reads = [F.coalesce(read_as(text, name).isNotNull(), F.lit(False)) for name in formats]
    present = text.isNotNull()
    first = F.min_by(F.array(*[r.cast("int") for r in reads]), F.when(present, F.col("pos")))
    counted = rows.groupBy(*KEYS).agg(
        F.count_if(present).alias("n_values"),
        F.max("pos").cast("bigint").alias("last_pos"),
        first.alias("first"),
        F.array(*[F.count_if(r) for r in reads]).alias("read"),
    )
    names = F.array(*[F.lit(name) for name in formats])
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(len(formats) - 1)),
        lambda i: F.struct(
            F.coalesce(F.get("first", i), F.lit(0)).alias("first"),
            F.get("read", i).alias("n_read"),
            (-i).alias("order"),
            F.get(names, i).alias("name"),
        ),
    )
    best = counted.withColumn("best", F.array_max(scores))
    return best.select(
        *KEYS,
        F.when(F.col("best.n_read") > 0, F.col("best.name")).alias("date_format"),
        "n_values",
        F.col("best.n_read").alias("n_read"),
        "last_pos",
    )


def with_elected_dates(
    rows: DataFrame,
    elected: DataFrame,
    value: str,
    name: str,
    formats: Sequence[str] = FORMATS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """`rows` with `date_format` and the date `name` that `value` has in its register's elected format.

    Values in any other format are no dates, as the format is the register's. A register's one row is
    repeated per slice of positions, so that no join key has more than `rows_per_slice` rows.
    """
    slices = F.expr(f"explode(sequence(0, int(last_pos div {rows_per_slice})))")
    sliced = elected.select(*KEYS, "date_format", slices.alias("slice"))
    joined = rows.withColumn("slice", F.expr(f"int(pos div {rows_per_slice})")).join(sliced, [*KEYS, "slice"])
    text = F.col(value).cast("string")
    date = F.lit(None).cast("timestamp_ntz")
    for pattern in reversed(formats):
        date = F.when(F.col("date_format") == pattern, read_as(text, pattern)).otherwise(date)
    return joined.withColumn(name, date).drop("slice")
