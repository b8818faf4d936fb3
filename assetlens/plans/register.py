"""A register: one table of assets whose columns have known roles."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.errors import ModelColumnMissing
from assetlens.operators.roles import REGION_ROLE, kind_of, resolve

# Headers of the derived columns. A column typed exactly so is replaced when they
# are derived.
DERIVED_HEADERS = {
    "asset_age": "Asset Age",
    "warranty_expiry_date": "Warranty Expiry Date",
    "days_to_expiry": "Days to Expiry",
    "warranty_status": "Warranty Status",
}


def clean_header_positions(headers: Iterable[str]) -> list[tuple[int, str]]:
    """Trimmed headers with their positions; of equal ones only the first."""
    first: dict[str, int] = {}
    for position, header in enumerate(headers):
        first.setdefault(str(header).strip(), position)
    return [(position, header) for header, position in first.items()]


def safe_names(headers: Iterable[str]) -> list[str]:
    """A column name per header that needs no quoting and differs in more than case."""
    reserved = {header: name for name, header in DERIVED_HEADERS.items()}
    taken: set[str] = set(reserved.values())
    names = []
    for header in headers:
        if header in reserved:
            names.append(reserved[header])
            continue
        base = re.sub("[^a-z0-9]+", "_", header.lower()).strip("_") or "column"
        name, number = base, 2
        while name in taken:
            name, number = f"{base}_{number}", number + 1
        taken.add(name)
        names.append(name)
    return names


@dataclass(frozen=True)
class Register:
    """Rows, the headers as typed per column name, the kind, and a column name per role."""

    df: DataFrame
    headers: dict[str, str]
    kind: str
    roles: dict[str, str]

    @staticmethod
    def of(df: DataFrame) -> Register:
        """Take any table of assets: clean its headers, classify it, resolve the roles.

        Only names are looked at; no job runs. Raises `ModelColumnMissing` where no column can
        be the model.
        """
        kept = clean_header_positions(df.columns)
        headers = [header for _, header in kept]
        names = safe_names(headers)
        # Positional names first: two headers may differ in case only.
        positional = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        rows = positional.select(
            *[F.col(f"_{i}").alias(name) for (i, _), name in zip(kept, names, strict=True)]
        )
        kind = kind_of(headers)
        roles = {role: names[i] for role, i in resolve(headers, kind).items()}
        if "model" not in roles:
            raise ModelColumnMissing(f"no model column among {headers}")
        return Register(rows, dict(zip(names, headers, strict=True)), kind, roles)

    def with_rows(self, df: DataFrame) -> Register:
        """The same register over other rows; columns added keep their derived headers."""
        headers = {
            name: self.headers.get(name, DERIVED_HEADERS.get(name, name)) for name in df.columns
        }
        return replace(self, df=df, headers=headers)

    def where(self, condition: Column) -> Register:
        """The rows that meet a condition."""
        return replace(self, df=self.df.where(condition))

    def has(self, role: str) -> bool:
        """Whether a column plays this role."""
        return role in self.roles

    def col(self, role: str) -> Column:
        """The column of a role."""
        return F.col(self.roles[role])

    @property
    def region_role(self) -> str:
        """The role that stands for the region of an asset."""
        return REGION_ROLE[self.kind]

    def role_columns(self, wanted: Iterable[str]) -> list[Column]:
        """The resolved ones of `wanted`, named by role; a column with two roles comes once."""
        by_column: dict[str, str] = {}
        for role in wanted:
            if self.has(role):
                by_column.setdefault(self.roles[role], role)
        return [F.col(name).alias(role) for name, role in by_column.items()]
