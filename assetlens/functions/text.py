"""Text expressions: header normalisation, missing-value markers, search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that a spreadsheet load reads as missing.
MISSING_MARKERS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def normalized(value: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def normalized_name(name: str) -> str:
    """`normalized` for a name that is already on the driver."""
    return re.sub("[^a-z0-9]", "", name.lower())


def without_markers(value: Column) -> Column:
    """NULL in place of the fixed markers of a missing cell."""
    return F.when(~value.isin(MISSING_MARKERS), value)


def matches_ignoring_case(value: Column, pattern: str) -> Column:
    """Whether a regular expression is found anywhere; NULL for NULL."""
    return value.rlike("(?iu)" + pattern)


def contains_ignoring_case(value: Column, text: str) -> Column:
    """Whether `text` itself is found anywhere, by the same test as a pattern; NULL for NULL."""
    return matches_ignoring_case(value, "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E")
