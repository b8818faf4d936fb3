"""Age and warranty as of a point in time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.dates import lenient_date, moment, whole_days
from assetlens.functions.labels import age_label, warranty_label
from assetlens.functions.numbers import lenient_number
from assetlens.plans.register import Register

AsOf = datetime | str | None


def age_known(year: Column) -> Column:
    """Whether a purchase year can be read at all; if not, the age is given as 0."""
    return lenient_number(year).isNotNull()


def age_in_years(year: Column, as_of: AsOf) -> Column:
    """Years since the purchase year, fractions cut off; 0 where the year is unreadable.

    The outer cast is lenient too: a year such as 1e300 does not fit.
    """
    years = F.year(moment(as_of)) - lenient_number(year)
    return F.coalesce(years.try_cast("bigint"), F.lit(0).cast("bigint"))


def with_age(register: Register, as_of: AsOf = None) -> Register:
    """Add `asset_age`; 0 throughout where there is no purchase year column."""
    if register.has("purchase_year"):
        age = age_in_years(register.col("purchase_year"), as_of)
    else:
        age = F.lit(0).cast("bigint")
    return register.with_rows(register.df.withColumn("asset_age", age))


def with_warranty(
    register: Register, as_of: AsOf = None, formats: Sequence[str] = ()
) -> Register:
    """Add expiry date, days to expiry and status; unchanged without a warranty column."""
    if not register.has("warranty_expiry"):
        return register
    expiry = lenient_date(register.col("warranty_expiry"), formats)
    days = whole_days(moment(as_of), F.col("warranty_expiry_date"))
    return register.with_rows(
        register.df.withColumn("warranty_expiry_date", expiry)
        .withColumn("days_to_expiry", days)
        .withColumn("warranty_status", warranty_label(F.col("days_to_expiry")))
    )


def derived(register: Register, as_of: AsOf = None, formats: Sequence[str] = ()) -> Register:
    """All derived columns; mobile registers have no warranty."""
    return with_warranty(with_age(register, as_of), as_of, formats)


def with_age_category(register: Register) -> Register:
    """Add `age_category`; needs `asset_age`."""
    return register.with_rows(
        register.df.withColumn("age_category", age_label(F.col("asset_age")))
    )


def asset_details(register: Register) -> DataFrame:
    """Every column but the purchase year."""
    if not register.has("purchase_year"):
        return register.df
    return register.df.drop(register.roles["purchase_year"])
