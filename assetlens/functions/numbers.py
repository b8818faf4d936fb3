"""Lenient numbers out of dirty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def lenient_number(value: Column) -> Column:
    """DOUBLE, or NULL where the text is not a plain decimal number.

    Spark's own cast also takes '2020d', 'inf' and 'NaN', hence the pattern. The value occurs
    once, as in the other expressions here: a filter on a derived column repeats its whole
    expression, and repeats of repeats outgrow what the JVM compiles.
    """
    return F.regexp_extract(value.cast("string"), NUMBER, 0).try_cast("double")
