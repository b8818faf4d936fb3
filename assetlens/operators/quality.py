"""The audit of a register: repeated identifiers, missing users, malformed addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.operators.skew import ROWS_PER_SLICE, semi_join_sliced
from assetlens.plans.register import Register

# The shape of an address (tied to its start only), and the wording and
# severity of the issues in report order.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ISSUES = [
    ("asset_tag", "Duplicate Asset Tags", "high", "Found %d duplicate asset tags"),
    ("serial_number", "Duplicate Serial Numbers", "high", "Found %d duplicate serial numbers"),
    ("user", "Missing User Assignment", "medium", "%d assets without assigned users"),
    ("user_email", "Invalid Email Format", "low", "%d invalid email addresses"),
]

# The columns shown with each issue, the checked one first where it is shown at all.
DETAILS = {
    "asset_tag": ["asset_tag", "model", "serial_number", "user"],
    "serial_number": ["serial_number", "model", "asset_tag", "user"],
    "user": ["asset_tag", "model", "serial_number", "department"],
    "user_email": ["user", "user_email", "asset_tag", "model"],
}


def is_missing_user(user: Column) -> Column:
    """NULL or empty; blanks count as a user."""
    return user.isNull() | (user.cast("string") == "")


def is_invalid_email(email: Column) -> Column:
    """Present, and does not start like an address."""
    return email.isNotNull() & ~email.cast("string").rlike(EMAIL_PATTERN)


def duplicate_values(register: Register, role: str) -> DataFrame | None:
    """Values that occur more than once, with their number of rows; None without the column."""
    if not register.has(role):
        return None
    return (
        register.df.select(register.col(role).alias(role))
        .where(F.col(role).isNotNull())
        .groupBy(role)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def duplicate_rows(
    register: Register, role: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame | None:
    """All rows of the values that occur more than once, sorted by value.

    Missing values are dropped before anything is shuffled.
    """
    counted = duplicate_values(register, role)
    if counted is None:
        return None
    rows = register.df.select(*register.role_columns(DETAILS[role])).where(F.col(role).isNotNull())
    # The slice ends the sort key, so that rows alike in all columns need not share a task.
    return (
        semi_join_sliced(rows, counted, role, rows_per_slice)
        .orderBy(*rows.columns, "slice")
        .select(*rows.columns)
    )


def missing_user_rows(register: Register) -> DataFrame | None:
    """Rows without a user; None without the column."""
    if not register.has("user"):
        return None
    missing = register.where(is_missing_user(register.col("user")))
    return missing.df.select(*missing.role_columns(DETAILS["user"]))


def invalid_email_rows(register: Register) -> DataFrame | None:
    """Rows with a malformed address; None without the column."""
    if not register.has("user_email"):
        return None
    invalid = register.where(is_invalid_email(register.col("user_email")))
    return invalid.df.select(*invalid.role_columns(DETAILS["user_email"]))


def quality_report(register: Register) -> DataFrame:
    """The issues that occur: issue, severity, n, details; in fixed order, possibly none.

    One scan and one shuffle for all checks. Every row turns into the findings it takes part
    in; repeated identifiers are counted per value, the other two under one key each, which
    the partial aggregation reduces to one row per task.
    """
    checks = [check for check, *_ in ISSUES]
    none = F.lit(None).cast("string")
    findings = []
    for number, check in enumerate(checks):
        if not register.has(check):
            continue
        column = register.col(check)
        if check == "user":
            applies, value = is_missing_user(column), none
        elif check == "user_email":
            applies, value = is_invalid_email(column), none
        else:
            applies, value = column.isNotNull(), column.cast("string")
        findings.append(
            F.struct(
                F.when(applies, number).alias("number"),
                value.alias("value"),
            )
        )
    if not findings:
        findings = [F.struct(F.lit(None).cast("int").alias("number"), none.alias("value"))]
    per_value = (
        register.df.select(F.inline(F.array(*findings)))
        .where(F.col("number").isNotNull())
        .groupBy("number", "value")
        .agg(F.count("*").alias("rows"))
    )
    repeated = [i for i, check in enumerate(checks) if check in ("asset_tag", "serial_number")]
    counts = per_value.groupBy("number").agg(
        F.sum(
            F.when(
                F.col("number").isin(repeated),
                F.when(F.col("rows") > 1, F.lit(1).cast("bigint")).otherwise(F.lit(0)),
            ).otherwise(F.col("rows"))
        ).alias("n")
    )
    wording = F.array(
        *[
            F.struct(
                F.lit(issue).alias("issue"),
                F.lit(severity).alias("severity"),
                F.lit(text).alias("text"),
            )
            for _, issue, severity, text in ISSUES
        ]
    )
    text = F.get(wording, F.col("number"))
    return (
        counts.where(F.col("n") > 0)
        .orderBy("number")
        .select(
            text["issue"].alias("issue"),
            text["severity"].alias("severity"),
            "n",
            F.regexp_replace(text["text"], F.lit("%d"), F.col("n").cast("string")).alias("details"),
        )
    )
