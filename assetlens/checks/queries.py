"""The registered queries: every operator over registers derived from whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.checks import derived as inputs
from assetlens.functions.labels import age_label
from assetlens.functions.text import normalized
from assetlens.operators import derive, filters, formats, headers, metrics, quality, roles
from assetlens.operators.filters import FilterSpec
from assetlens.operators.roles import MOBILE, WORKSTATION
from assetlens.plans.dashboard import COUNTED_ROLES
from assetlens.plans.register import Register
from assetlens.session import new_path, staged
from assetlens.sinks import exports
from assetlens.sources import delimited, workbooks

Query = Callable[[SparkSession, str], DataFrame]
RegisterQuery = Callable[[Register], DataFrame]

WORKSTATION_SPEC = FilterSpec(
    selections={"department": ["BUILDING"]},
    replacement_models=["Brand#1", "Brand#2"],
    search="nation_1$",
)
MOBILE_SPEC = FilterSpec(
    selections={"programme": ["1-URGENT", "2-HIGH"], "site": ["ASIA", None]},
    replacement_models=["small ring", "red widget"],
    search="nation_1",
)
# Values per selectable role; None selects missing ones.
WORKSTATION_CHOICES: dict[str, list[str | None]] = {
    "model": ["Brand#1", "Brand#2"],
    "asset_kind": ["ECONOMY"],
    "site": ["1-URGENT"],
    "location": ["NATION_1", "NATION_2"],
    "department": ["BUILDING", None],
    "status": ["F"],
    "place": ["ASIA", None],
    "state": ["P"],
}
MOBILE_CHOICES: dict[str, list[str | None]] = {
    "programme": ["1-URGENT", "2-HIGH"],
    "site": [None],
}
SEARCH = "nation_1$|^brand#2[0-3]$"
LITERAL = "(old)"
MODELS_PER_BLOCK = 10


# ------------------------------------------------------------------------- inputs


def workstations(spark: SparkSession, sf_dir: str) -> Register:
    """The workstation register with its derived columns."""
    return derive.derived(inputs.workstation_register(spark, sf_dir), inputs.AS_OF)


def mobiles(spark: SparkSession, sf_dir: str) -> Register:
    """The mobile register, likewise."""
    return derive.derived(inputs.mobile_register(spark, sf_dir), inputs.AS_OF)


def on_workstations(query: RegisterQuery) -> Query:
    return lambda spark, sf_dir: query(workstations(spark, sf_dir))


def on_mobiles(query: RegisterQuery) -> Query:
    return lambda spark, sf_dir: query(mobiles(spark, sf_dir))


# -------------------------------------------------------- workbooks, grids, headers


def workbook_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbooks.triage(inputs.workbooks(spark, sf_dir)).select("path", "accepted")


def upload_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = workbooks.uploads(spark, inputs.upload_folder(spark, sf_dir))
    name = F.substring_index("path", "/", -2).alias("path")
    return workbooks.triage(files).select(name, (F.col("length") == 0).alias("is_empty"), "accepted")


def sheet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbooks.sheet_list(inputs.workbooks(spark, sf_dir)).drop("error")


def workbook_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = staged(workbooks.raw_grid(inputs.workbooks(spark, sf_dir)))
    cells = F.array_join("cells", "|", "-").alias("cells")
    return workbooks.readable_grid(raw).select("path", "sheet", "pos", "width", cells)


def workbook_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = staged(workbooks.raw_grid(inputs.workbooks(spark, sf_dir)))
    grid = workbooks.readable_grid(raw)
    return headers.canonical_rows(grid, stored_registers(grid)).select(
        "path", "sheet", "pos", "asset_type", "asset_tag", "model", "user", "warranty_expiry"
    )


def stored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, which is a stored table: several branches read it."""
    return inputs.grid(spark, sf_dir)


def stored_registers(grid: DataFrame) -> DataFrame:
    """The registers of a grid, as a stored table."""
    return staged(headers.register_table(grid))


def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.detect_header_rows(inputs.grid(spark, sf_dir))


def header_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = headers.detect_header_rows(inputs.grid(spark, sf_dir))
    return headers.override_header_rows(detected, inputs.overrides(spark, sf_dir))


def promote_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored_grid(spark, sf_dir)
    return headers.promote_headers(grid, stored_registers(grid))


def promote_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = inputs.grid(spark, sf_dir)
    registers = headers.register_table(grid, inputs.overrides(spark, sf_dir))
    return registers.select("path", "header_row", F.size("columns").alias("total_columns"))


def promote_override_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored_grid(spark, sf_dir)
    registers = staged(headers.register_table(grid, inputs.overrides(spark, sf_dir)))
    return headers.promote_headers(grid, registers)


def filter_domains_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored_grid(spark, sf_dir)
    rows = headers.canonical_rows(grid, stored_registers(grid), with_present=True)
    return filters.domains_in_order(rows).drop("sheet")


def warranty_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.dated_rows(spark, sf_dir)
    elected = staged(formats.elected_formats(rows, "value"))
    return formats.with_elected_dates(rows, elected, "value", "warranty_expiry_date").drop("sheet")


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.elected_formats(inputs.dated_rows(spark, sf_dir), "value").drop("sheet", "last_pos")


def delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = delimited.delimited_grid(spark, inputs.printouts(spark, sf_dir))
    cell = [F.get("cells", F.lit(i)) for i in range(4)]
    return grid.select(
        cell[0].cast("bigint").alias("c_custkey"), cell[1].alias("note"), cell[2].alias("name"), cell[3].alias("place"), "width"
    )


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three exports of the workstation register, written and read again."""
    register = workstations(spark, sf_dir)
    shown, replacement = filters.apply_filters(register, WORKSTATION_SPEC)
    as_of = datetime.fromisoformat(inputs.AS_OF)
    folder = new_path(spark, "exports")
    folders = exports.commit_exports(folder, shown, replacement, filters.warranty_expired(register), as_of)
    read = [
        exports.read_export(spark, path).select(
            F.lit(path.rsplit("/", 1)[1]).alias("export"),
            *[F.col(f"`{header}`").alias(name) for name, header in EXPORTED.items()],
        )
        for path in folders.values()
    ]
    return reduce(DataFrame.unionAll, read)


EXPORTED = {"asset_tag": "Asset Tag", "model": "Model", "serial_number": "Serial Number", "days_to_expiry": "Days to Expiry"}


def registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.register_table(stored_grid(spark, sf_dir))


def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers(spark, sf_dir).select("path", F.inline("columns"))


def column_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.column_catalogue(registers(spark, sf_dir)).drop("sheet")


def normalize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_catalogue(spark, sf_dir).select(
        "path", "ordinal", "name", normalized(F.col("name")).alias("normalized")
    )


def resolve_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.resolved_roles(registers(spark, sf_dir)).drop("sheet")


def asset_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.asset_types(registers(spark, sf_dir)).drop("sheet")


def missing_model_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.missing_model(registers(spark, sf_dir)).drop("sheet")


def canonical_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored_grid(spark, sf_dir)
    return headers.canonical_rows(grid, stored_registers(grid)).drop("sheet", "cells")


def search_all_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored_grid(spark, sf_dir)
    rows = headers.canonical_rows(grid, stored_registers(grid))
    found = F.exists("cells", lambda v: filters.found_in([v], "^V[0-9]*7_[12]$"))
    return rows.where(found).select("path", "pos", "asset_type")


# ------------------------------------------------------------------------ registers


def rows_with(register: Register, *columns: str) -> DataFrame:
    """Identifying columns and those named."""
    return register.df.select("asset_tag", "serial_number", *columns)


def asset_age(register: Register) -> DataFrame:
    known = derive.age_known(register.col("purchase_year")).alias("age_known")
    return register.df.select(
        "asset_tag",
        "serial_number",
        "year_of_purchase",
        "asset_age",
        F.coalesce(known, F.lit(False)).alias("age_known"),
    )


def age_category(register: Register) -> DataFrame:
    label = age_label(F.col("asset_age")).alias("age_category")
    return register.df.select("asset_tag", "serial_number", "asset_age", label)


def filter_by(role: str, choices: dict[str, list[str | None]]) -> RegisterQuery:
    def run(register: Register) -> DataFrame:
        chosen = filters.selected(register, {role: choices[role]})
        return chosen.df.select("asset_tag", "serial_number", chosen.col(role).alias(role))

    return run


def replacement_set(spec: FilterSpec) -> RegisterQuery:
    def run(register: Register) -> DataFrame:
        _, replacement = filters.apply_filters(register, spec)
        return replacement.df

    return run


def shown_rows(spec: FilterSpec) -> RegisterQuery:
    return lambda register: filters.apply_filters(register, spec)[0].df


def duplicate_summary(role: str) -> RegisterQuery:
    return lambda register: quality.duplicate_values(register, role)


def count_of(rows: Callable[[Register], DataFrame]) -> RegisterQuery:
    return lambda register: rows(register).agg(F.count("*").alias("n"))


def shown_pivot(register: Register) -> DataFrame:
    return metrics.region_model_pivot(register, metrics.pivot_models(register))


def shown_blocks(register: Register) -> DataFrame:
    """The cross-tab in blocks, with a block's models as one text."""
    cells = F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    blocks = metrics.region_model_blocks(register, MODELS_PER_BLOCK)
    return blocks.withColumn("models", F.array_join(cells, "|"))


def register_queries(kind: str) -> dict[str, RegisterQuery]:
    """What is registered for both kinds of register."""
    spec = WORKSTATION_SPEC if kind == WORKSTATION else MOBILE_SPEC
    choices = WORKSTATION_CHOICES if kind == WORKSTATION else MOBILE_CHOICES
    queries: dict[str, RegisterQuery] = {
        "export_all": shown_rows(spec),
        "export_replacement": replacement_set(spec),
        "asset_age": asset_age,
        "age_category": age_category,
        "asset_details": derive.asset_details,
        "filter_domains": filters.filter_domains,
        "replacement_set": lambda r: rows_with(
            r.with_rows(replacement_set(spec)(r)), r.roles["model"]
        ),
        "search_all_fields": lambda r: rows_with(
            filters.searched(r, SEARCH), r.roles["model"], "location"
        ),
        "duplicate_asset_tags": duplicate_summary("asset_tag"),
        "duplicate_asset_tags_detail": lambda r: quality.duplicate_rows(r, "asset_tag"),
        "duplicate_serials": duplicate_summary("serial_number"),
        "duplicate_serials_detail": lambda r: quality.duplicate_rows(r, "serial_number"),
        "missing_user": count_of(quality.missing_user_rows),
        "missing_user_detail": quality.missing_user_rows,
        "quality_report": quality.quality_report,
        "summary_kpis": lambda r: metrics.summary_kpis(r, spec),
        "counters": lambda r: metrics.counters(r, spec),
        "role_counts": lambda r: metrics.role_counts(r, COUNTED_ROLES),
        "type_counts": metrics.type_counts,
        "age_counts": metrics.age_counts,
        "age_summary": metrics.age_summary,
        "model_counts": metrics.model_counts,
        "region_model_cube": metrics.region_model_cube,
        "region_model_blocks": shown_blocks,
        "model_share": metrics.model_share,
        "top_departments": lambda r: metrics.top_values(r, "department"),
        "top_locations": lambda r: metrics.top_values(r, "location"),
    }
    for role in choices:
        queries[f"filter_by_{filter_name(role)}"] = filter_by(role, choices)
    return queries


def filter_name(role: str) -> str:
    """Short name of a role in the names of the filter queries."""
    return "kind" if role == "asset_kind" else role


def mobile_name(name: str) -> str:
    """Name of a query over the mobile register; only that one has programmes."""
    return name if name.endswith("_programme") else f"mobile_{name}"


WORKSTATION_ONLY: dict[str, RegisterQuery] = {
    "export_warranty": lambda r: filters.warranty_expired(r).df,
    "warranty_date": lambda r: rows_with(r, "warranty_expiry", "warranty_expiry_date"),
    "days_to_expiry": lambda r: rows_with(r, "warranty_expiry", "days_to_expiry"),
    "warranty_status": lambda r: rows_with(r, "days_to_expiry", "warranty_status"),
    "warranty_counts": metrics.warranty_counts,
    "warranty_drilldown": filters.warranty_drilldown,
    "filter_multi": lambda r: rows_with(
        filters.selected(
            r, {"model": ["Brand#1", "Brand#2"], "department": ["BUILDING", None]}
        ),
        "model",
        "department",
    ),
    "search_literal": lambda r: rows_with(
        filters.searched(r, LITERAL, regex=False), "user_email"
    ),
    "invalid_emails": count_of(quality.invalid_email_rows),
    "invalid_emails_detail": quality.invalid_email_rows,
    "region_model_pivot": shown_pivot,
}

INGEST: dict[str, Query] = {
    "workbook_triage": workbook_triage,
    "upload_triage": upload_triage,
    "sheet_list": sheet_list,
    "workbook_grid": workbook_grid,
    "workbook_register": workbook_register,
    "header_row": header_row,
    "header_override": header_override,
    "promote_header": promote_header,
    "promote_override": promote_override,
    "promote_override_rows": promote_override_rows,
    "filter_domains_in_order": filter_domains_in_order,
    "date_formats": date_formats,
    "warranty_date_formats": warranty_date_formats,
    "delimited_records": delimited_records,
    "export_files": export_files,
    "clean_columns": clean_columns,
    "column_catalogue": column_catalogue,
    "normalize_headers": normalize_headers,
    "resolve_roles": resolve_roles,
    "asset_type": asset_type,
    "missing_model_extracts": missing_model_extracts,
    "canonical_register": canonical_register,
    "search_all_registers": search_all_registers,
}


def all_queries() -> dict[str, Query]:
    """Every registered query by name."""
    queries = dict(INGEST)
    for name, query in (WORKSTATION_ONLY | register_queries(WORKSTATION)).items():
        queries[name] = on_workstations(query)
    for name, query in register_queries(MOBILE).items():
        queries[mobile_name(name)] = on_mobiles(query)
    return queries
