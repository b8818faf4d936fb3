"""What the plans must and must not contain."""

import re

import pytest

from assetlens import FilterSpec, Register
from assetlens.checks import derived as inputs
from assetlens.checks.queries import all_queries
from assetlens.operators import filters, headers, metrics
from assetlens.operators.derive import derived

WITH_PYTHON = {"sheet_list", "upload_triage"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    """The workstation register as a stored table."""
    path = str(tmp_path_factory.mktemp("register") / "workstations")
    register = inputs.workstation_register(spark, small)
    register.df.toDF(*register.headers.values()).write.parquet(path)
    return derived(Register.of(spark.read.parquet(path)), inputs.AS_OF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_no_python_and_no_cross_join(spark, small, name):
    text = plan(all_queries()[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # Every window is over the rows of a key: of a register's headers, or of a file's split.
    for line in text.splitlines():
        if "Window " in line or "WindowGroupLimit " in line:
            assert re.search(r"(path|task)#\d+", line), line
    if name not in WITH_PYTHON:
        assert "Python" not in text and "InArrow" not in text and "InPandas" not in text


def test_selections_reach_the_scan(stored):
    spec = {"model": ["Brand#1"], "place": ["ASIA"], "department": ["BUILDING", None]}
    text = plan(filters.selected(stored, spec).df.select("asset_tag"))
    pushed = text.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "EqualTo(Model,Brand#1)" in pushed and "Or(EqualTo(Department,BUILDING)" in pushed


def test_only_used_columns_are_read(stored):
    schema = plan(metrics.region_model_cube(stored)).split("ReadSchema: ")[1].split(">")[0]
    assert schema.count(":") == 2
    schema = plan(metrics.warranty_counts(stored)).split("ReadSchema: ")[1].split(">")[0]
    assert schema.count(":") == 1


def test_top_values_are_not_sorted_as_a_whole(stored):
    assert "TakeOrderedAndProject" in plan(metrics.top_values(stored, "location"))


def test_key_figures_take_one_pass(stored):
    spec = FilterSpec(replacement_models=["Brand#1"], search="nation")
    text = plan(metrics.counters(stored, spec))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1


def test_report_takes_one_scan(stored):
    from assetlens.operators.quality import quality_report

    assert plan(quality_report(stored)).count("FileScan") == 1


def test_counted_cells_are_shared(stored):
    df = metrics.region_model_cube(stored)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_headers_are_found_without_reading_all_cells(spark, small, tmp_path):
    path = str(tmp_path / "grid")
    inputs.grid(spark, small).write.parquet(path)
    registers = headers.register_table(spark.read.parquet(path))
    scans = [line for line in plan(registers).splitlines() if "FileScan" in line]
    assert len(scans) == 2
    extent, preview = sorted(scans, key=lambda line: "cells" in line.split("ReadSchema")[1])
    assert "cells" not in extent.split("ReadSchema")[1]
    assert "LessThanOrEqual(pos,20)" in preview
    # Both parts are partitioned by register already when they meet; three more are for naming the headers.
    assert plan(registers).count("Exchange hashpartitioning(path") == 5
