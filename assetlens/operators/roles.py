"""Which column plays which role, and what kind of register this is.

Two forms share one table of terms: plain functions over the header list of one table, and
column expressions over an array of headers, one row per register. The second form never
shuffles: all it needs of a register sits in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import normalized_name

WORKSTATION = "Workstation"
MOBILE = "Mobile"
KINDS = (WORKSTATION, MOBILE)

# Header fragments that speak for a kind.
KIND_IDENTIFIERS = {
    WORKSTATION: ["workstation", "model", "warranty", "place"],
    MOBILE: ["product", "programme", "program"],
}

# Per role the header fragments that name it, in order of priority.
SHARED_TERMS = {
    "purchase_year": ["year of purchase"],
    "asset_tag": ["asset tag"],
    "serial_number": ["serial number"],
    "user": ["user"],
    "user_email": ["email"],
    "department": ["department"],
    "location": ["location"],
    "site": ["site"],
    "state": ["state"],
}
KIND_TERMS = {
    WORKSTATION: {
        "model": ["model"],
        "asset_kind": ["workstation type"],
        "warranty_expiry": ["warranty expiry"],
        "place": ["place"],
        "status": ["workstation status"],
    },
    MOBILE: {
        "model": ["product"],
        "asset_kind": ["product type"],
        "programme": ["programme", "program"],
    },
}

# The roles in the order of the canonical table.
ROLES = [
    "asset_tag",
    "model",
    "asset_kind",
    "serial_number",
    "user",
    "user_email",
    "department",
    "location",
    "site",
    "place",
    "purchase_year",
    "warranty_expiry",
    "status",
    "state",
    "programme",
]

# The role that stands for the region.
REGION_ROLE = {WORKSTATION: "place", MOBILE: "site"}


def role_terms(kind: str) -> dict[str, list[str]]:
    """Normalised terms per role for one kind of register."""
    terms = SHARED_TERMS | KIND_TERMS[kind]
    return {role: [normalized_name(t) for t in terms[role]] for role in ROLES if role in terms}


# ---------------------------------------------------------------------- one table


def find_column(headers: Sequence[str], terms: Sequence[str]) -> int | None:
    """Index of the column that plays a role.

    Earlier terms win over later ones, then earlier columns. Headers that normalise alike count
    as one: it stands where the first of them stands, and means the last of them.
    """
    names = [normalized_name(h) for h in headers]
    for term in map(normalized_name, terms):
        hit = next((n for n in names if term in n), None)
        if hit is not None:
            return len(names) - 1 - names[::-1].index(hit)
    return None


def kind_of(headers: Sequence[str]) -> str:
    """Workstation if strictly more of its identifiers occur, otherwise Mobile."""
    names = [normalized_name(h) for h in headers]
    score = {
        kind: sum(any(i in n for n in names) for i in identifiers)
        for kind, identifiers in KIND_IDENTIFIERS.items()
    }
    return WORKSTATION if score[WORKSTATION] > score[MOBILE] else MOBILE


def resolve(headers: Sequence[str], kind: str) -> dict[str, int]:
    """Column index per role that can be resolved."""
    found = {role: find_column(headers, terms) for role, terms in role_terms(kind).items()}
    return {role: index for role, index in found.items() if index is not None}


# ------------------------------------------------------- many registers, one row each
#
# These expressions are written as SQL text: they are long, and text is built in one call.


def kind_score_sql(kind: str) -> str:
    """How many identifiers of `kind` occur in the array `normalized`."""
    found = [f"int(exists(normalized, h -> contains(h, '{i}')))" for i in KIND_IDENTIFIERS[kind]]
    return " + ".join(found)


def role_column_sql(terms: Sequence[str]) -> str:
    """`find_column` over the array `normalized`: the entry of `columns`, NULL if unresolved."""
    firsts = ", ".join(f"get(filter(normalized, h -> contains(h, '{t}')), 0)" for t in terms)
    last = f"size(normalized) - array_position(reverse(normalized), coalesce({firsts}))"
    return f"get(columns, int({last}))"


def classified(registers: DataFrame) -> DataFrame:
    """Add both scores and `asset_type` to a table with a `columns` array of (col, name).

    Also adds `normalized`, the normalised names. All come out of one expression that mentions
    `columns` once: what a filter on them repeats is short then.
    """
    scores = ", ".join(f"'{kind.lower()}_score', {kind_score_sql(kind)}" for kind in KINDS)
    names = "transform(columns, c -> regexp_replace(lower(c.name), '[^a-z0-9]', ''))"
    facts = f"named_struct('normalized', normalized, {scores})"
    scored = registers.withColumn(
        "facts", F.expr(f"get(transform(array({names}), normalized -> {facts}), 0)")
    ).select("*", "facts.*")
    better = F.col("workstation_score") > F.col("mobile_score")
    return scored.drop("facts").withColumn(
        "asset_type", F.when(better, WORKSTATION).otherwise(MOBILE)
    )


def with_roles(registers: DataFrame) -> DataFrame:
    """Add `roles`, a struct that holds (col, name) per role, to a table of registers.

    `col` points into the raw cells of the register's grid rows.
    """
    typed = registers if "asset_type" in registers.columns else classified(registers)
    terms = {kind: role_terms(kind) for kind in KINDS}
    fields = []
    for role in ROLES:
        if role in SHARED_TERMS:
            column = role_column_sql(terms[MOBILE][role])
        else:
            cases = " ".join(
                f"when '{kind}' then {role_column_sql(terms[kind][role])}"
                for kind in KINDS
                if role in terms[kind]
            )
            column = f"case asset_type {cases} end"
        fields.append(f"'{role}', {column}")
    return typed.withColumn("roles", F.expr(f"named_struct({', '.join(fields)})"))


def resolved_roles(registers: DataFrame) -> DataFrame:
    """One row per register and resolved role: asset type, role, header name and column."""
    entries = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.col(f"roles.{role}.name").alias("name"),
                F.col(f"roles.{role}.col").alias("col"),
            )
            for role in ROLES
        ]
    )
    return (
        with_roles(registers)
        .select("path", "sheet", "asset_type", F.inline(entries))
        .where(F.col("name").isNotNull())
    )


def asset_types(registers: DataFrame) -> DataFrame:
    """Kind of every register, with the scores behind it."""
    return classified(registers).select(
        "path", "sheet", "workstation_score", "mobile_score", "asset_type"
    )


def missing_model(registers: DataFrame) -> DataFrame:
    """The registers that have no model column, which makes them unusable."""
    found = " ".join(
        f"when '{kind}' then exists(normalized, h -> contains(h, '{role_terms(kind)['model'][0]}'))"
        for kind in KINDS
    )
    return (
        classified(registers)
        .where(f"not case asset_type {found} end")
        .select("path", "sheet", "asset_type", "header_row")
    )
