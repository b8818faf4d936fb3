"""All results of one register, as lazy tables over one filtered table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from assetlens.operators import metrics, quality
from assetlens.operators.derive import AsOf, asset_details, derived
from assetlens.operators.filters import (
    FilterSpec,
    apply_filters,
    filter_domains,
    warranty_drilldown,
    warranty_expired,
)
from assetlens.operators.roles import WORKSTATION
from assetlens.plans.register import Register
from assetlens.sinks.exports import write_exports


# The roles whose values are counted somewhere on the dashboard.
COUNTED_ROLES = ["asset_kind", "model", "department", "location"]


@dataclass(frozen=True)
class Dashboard:
    """Tables of one register. Those a register has no columns for are None."""

    everything: Register
    shown: Register
    replacement: Register | None
    expired_warranty: Register | None
    filter_domains: DataFrame
    quality_report: DataFrame
    quality_details: dict[str, DataFrame | None]
    kpis: DataFrame
    counters: DataFrame
    role_counts: DataFrame
    type_counts: DataFrame | None
    warranty_counts: DataFrame | None
    warranty_drilldown: DataFrame | None
    age_counts: DataFrame
    age_summary: DataFrame
    model_counts: DataFrame
    region_model_cube: DataFrame | None
    model_share: DataFrame
    top_departments: DataFrame | None
    top_locations: DataFrame | None
    details: DataFrame

    def export(
        self, base: str, as_of: datetime, fmt: str = "parquet", mode: str = "errorifexists"
    ) -> dict[str, str]:
        """Write the three exports under `base`."""
        return write_exports(
            base, self.shown, self.replacement, self.expired_warranty, as_of, fmt, mode
        )


def dashboard(
    register: Register,
    spec: FilterSpec | None = None,
    as_of: AsOf = None,
    formats: Sequence[str] = (),
    persist: bool = False,
) -> Dashboard:
    """Plan every result; nothing runs until a table is used.

    The audit and the warranty export look at the whole register, everything else at the rows
    left by the filters. `counters` and `role_counts` hold all figures and counts from one pass
    each; the single results read no more than the columns they need. With `persist` the
    derived table is kept between results; pieces on a lost executor are computed again.
    """
    spec = spec or FilterSpec()
    whole = derived(register, as_of, formats)
    if persist:
        whole = whole.with_rows(whole.df.persist())
    shown, replacement = apply_filters(whole, spec)
    has_status = whole.kind == WORKSTATION and "warranty_status" in whole.df.columns
    return Dashboard(
        everything=whole,
        shown=shown,
        replacement=replacement,
        expired_warranty=warranty_expired(whole) if whole.has("warranty_expiry") else None,
        filter_domains=filter_domains(whole),
        quality_report=quality.quality_report(whole),
        quality_details={
            "asset_tag": quality.duplicate_rows(whole, "asset_tag"),
            "serial_number": quality.duplicate_rows(whole, "serial_number"),
            "user": quality.missing_user_rows(whole),
            "user_email": quality.invalid_email_rows(whole),
        },
        kpis=metrics.summary_kpis(whole, spec),
        counters=metrics.counters(whole, spec),
        role_counts=metrics.role_counts(shown, COUNTED_ROLES),
        type_counts=metrics.type_counts(shown),
        warranty_counts=metrics.warranty_counts(shown) if has_status else None,
        warranty_drilldown=warranty_drilldown(shown) if has_status else None,
        age_counts=metrics.age_counts(shown),
        age_summary=metrics.age_summary(shown),
        model_counts=metrics.model_counts(shown),
        region_model_cube=metrics.region_model_cube(shown),
        model_share=metrics.model_share(shown),
        top_departments=metrics.top_values(shown, "department"),
        top_locations=metrics.top_values(shown, "location"),
        details=asset_details(shown),
    )
