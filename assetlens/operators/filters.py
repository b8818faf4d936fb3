"""Selections, replacement marks and the search over all fields."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.errors import SearchPatternError
from assetlens.functions.patterns import java_pattern
from assetlens.functions.text import contains_ignoring_case, matches_ignoring_case
from assetlens.operators.roles import MOBILE, WORKSTATION
from assetlens.plans.register import Register

# The roles a selection may be made on, in the order in which they are offered.
SELECTABLE = {
    WORKSTATION: [
        "model",
        "asset_kind",
        "site",
        "location",
        "department",
        "status",
        "place",
        "state",
    ],
    MOBILE: ["model", "asset_kind", "site", "location", "department", "programme", "state"],
}


@dataclass(frozen=True)
class FilterSpec:
    """What a person chose: values per role, models to replace, a search text."""

    selections: Mapping[str, Sequence[str | None]] = field(default_factory=dict)
    replacement_models: Sequence[str | None] = ()
    search: str | None = None
    regex: bool = True


def one_of(column: Column, values: Sequence[str | None]) -> Column:
    """Membership; a None among the values selects missing ones.

    For a missing value this is NULL where it is not selected, which filters and counts take as
    no. Only in this plain form do scans understand the test.
    """
    present = [v for v in values if v is not None]
    if None not in values:
        return column.isin(present)
    return column.isin(present) | column.isNull() if present else column.isNull()


def effective_selections(
    register: Register, selections: Mapping[str, Sequence[str | None]]
) -> dict[str, Sequence[str | None]]:
    """Chosen values per column. Of two roles on one column the later offered one counts."""
    offered = [role for role in SELECTABLE[register.kind] if register.has(role)]
    unknown = set(selections) - set(offered)
    if unknown:
        raise ValueError(f"this {register.kind} register cannot be filtered by {sorted(unknown)}")
    chosen = {register.roles[role]: selections.get(role, ()) for role in offered}
    return {column: values for column, values in chosen.items() if values}


def selected(register: Register, selections: Mapping[str, Sequence[str | None]]) -> Register:
    """Rows that meet every selection; an empty one selects all."""
    tests = [
        one_of(F.col(column), values)
        for column, values in effective_selections(register, selections).items()
    ]
    return register.where(reduce(operator.and_, tests)) if tests else register


def marked_for_replacement(register: Register, models: Sequence[str | None]) -> Column:
    """Whether a row's model is among the models to replace."""
    return one_of(register.col("model"), models)


def check_pattern(pattern: str) -> None:
    """Fails on a pattern that the JVM, which runs it, doesn't accept."""
    session = SparkSession.getActiveSession()
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile("(?iu)" + pattern)
    except IllegalArgumentException as error:
        raise SearchPatternError(f"{pattern!r}: {error}") from error


def found_in(columns: Sequence[Column], text: str, regex: bool = True) -> Column:
    """Whether any of the columns holds the text, ignoring case; by default a regular expression as Python has it."""
    if regex:
        text = java_pattern(text)
        check_pattern(text)
    found = matches_ignoring_case if regex else contains_ignoring_case
    # A chain of tests, not an array of values: it stays in generated code and stops at a hit.
    return reduce(operator.or_, [found(c.cast("string"), text) for c in columns])


def found_anywhere(register: Register, spec: FilterSpec) -> Column:
    """The search of a spec over all columns of the register; true without a search."""
    if not spec.search:
        return F.lit(True)
    return found_in([F.col(c) for c in register.df.columns], spec.search, spec.regex)


def searched(register: Register, text: str, regex: bool = True) -> Register:
    """Rows in which any column, derived ones included, holds the text."""
    return register.where(found_anywhere(register, FilterSpec(search=text, regex=regex)))


def apply_filters(register: Register, spec: FilterSpec) -> tuple[Register, Register | None]:
    """The rows to show, and the rows to replace (None if no model was marked).

    The rows to replace are taken after the selections but before the search.
    """
    chosen = selected(register, spec.selections)
    replacement = None
    if spec.replacement_models:
        replacement = chosen.where(marked_for_replacement(chosen, spec.replacement_models))
    shown = chosen.where(found_anywhere(chosen, spec)) if spec.search else chosen
    return shown, replacement


def filter_domains(register: Register) -> DataFrame:
    """Distinct values per selectable role, missing ones included, in one pass."""
    roles = [role for role in SELECTABLE[register.kind] if register.has(role)]
    pairs = F.array(
        *[F.struct(F.lit(r).alias("role"), register.col(r).cast("string").alias("value")) for r in roles]
    )
    return register.df.select(F.inline(pairs)).distinct().orderBy("role", "value")


def domains_in_order(rows: DataFrame) -> DataFrame:
    """Per register of canonical `rows` (with `present`): role, value and first_row, the position where it first stands.

    The values a person may choose from, missing ones included, in the order in which they appear in the
    register, which `first_row` gives. One aggregate; a register's size or a frequent value doesn't matter.
    """
    offered = [
        F.when(F.col("asset_type") == kind, F.array(*[F.lit(role) for role in roles])) for kind, roles in SELECTABLE.items()
    ]
    chosen = F.array_intersect(F.coalesce(*offered), F.col("present"))
    every = sorted({role for roles in SELECTABLE.values() for role in roles})
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("value")) for r in every])
    kept = F.filter(pairs, lambda pair: F.array_contains(chosen, pair["role"]))
    named = rows.select("path", "sheet", "pos", F.inline(kept))
    return named.groupBy("path", "sheet", "role", "value").agg(F.min("pos").alias("first_row"))


def warranty_drilldown(register: Register) -> DataFrame:
    """Rows per shown status with the columns of the lists; needs the warranty columns.

    Every status but Unknown is shown, and Unknown is what has no days to expiry.
    """
    columns = register.role_columns(
        ["model", "serial_number", "user", "department", "location", "warranty_expiry"]
    )
    return register.df.where(F.col("days_to_expiry").isNotNull()).select(
        "warranty_status", *columns
    )


def warranty_expired(register: Register) -> Register:
    """Rows whose warranty is over; the days say so more cheaply than the status."""
    return register.where(F.col("days_to_expiry") < 0)
