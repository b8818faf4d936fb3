"""Points in time without a zone, lenient date parsing, whole days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\s*$"
MICROS_PER_DAY = 86_400_000_000
# More days than lie between any two dates of the years 1 to 9999.
DAY_SHIFT = 4_000_000


def moment(as_of: datetime | str | None = None) -> Column:
    """TIMESTAMP_NTZ of `as_of`; the session's local clock when none is given."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, datetime):
        as_of = as_of.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp_ntz")


def iso_date(text: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO date, with or without a time of day, or NULL."""
    return F.regexp_extract(text, ISO_DATE, 0).try_cast("timestamp_ntz")


def patterned_date(text: Column, pattern: str) -> Column:
    """TIMESTAMP_NTZ of text in a Spark date pattern, or NULL.

    It is parsed against a fixed zone, so that a clock change of the session zone cannot move a value.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(pattern + " XXX"))
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def lenient_date(value: Column, formats: Sequence[str] = ()) -> Column:
    """TIMESTAMP_NTZ, or NULL for text that is no date.

    ISO dates, with or without a time of day, are always read. `formats` adds Spark date
    patterns, tried in order.
    """
    text = value.cast("string")
    return F.coalesce(iso_date(text), *[patterned_date(text, pattern) for pattern in formats])


def whole_days(start: Column, end: Column) -> Column:
    """Days from `start` to `end` as BIGINT, rounded down also below zero.

    Integer division cuts towards zero; so the difference is made positive first.
    """
    shift = F.lit(DAY_SHIFT * MICROS_PER_DAY)
    shifted = F.timestamp_diff("MICROSECOND", start, end) + shift
    return F.call_function("div", shifted, F.lit(MICROS_PER_DAY)) - F.lit(DAY_SHIFT)
