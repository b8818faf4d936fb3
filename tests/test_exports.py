"""Exports: names, contents, and which of them are written."""

from datetime import datetime

import pytest

from assetlens import FilterSpec, Register, dashboard
from assetlens.sinks import exports
from assetlens.sinks.exports import export_name, with_typed_headers, write_export
from templates import (
    AS_OF,
    MOBILE_HEADERS,
    MOBILE_ROWS,
    WORKSTATION_HEADERS,
    WORKSTATION_ROWS,
    table,
)

DAY = datetime(2025, 6, 15, 10, 30)


def test_names():
    assert export_name("Workstation", "all", DAY) == "workstation_assets_20250615"
    assert export_name("Mobile", "replacement", DAY) == "mobile_expired_20250615"
    assert export_name("Workstation", "warranty", DAY) == "warranty_expired_20250615"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    register = Register.of(table(spark, WORKSTATION_HEADERS, WORKSTATION_ROWS))
    # The warranty export is not narrowed by the filters, the others are.
    spec = FilterSpec(selections={"place": ["Singapore"]}, replacement_models=["Laptop C"])
    folders = dashboard(register, spec, AS_OF).export(str(tmp_path), DAY, fmt)
    assert set(folders) == {"all", "replacement", "warranty"}
    read = spark.read.option("header", "true").format(fmt)
    shown = read.load(folders["all"])
    assert shown.columns == [
        *WORKSTATION_HEADERS, "Asset Age", "Warranty Expiry Date", "Days to Expiry",
        "Warranty Status",
    ]
    assert [tuple(r)[:14] for r in shown.collect()] == [WORKSTATION_ROWS[2]]
    tags = {r["Asset Tag"] for r in read.load(folders["warranty"]).collect()}
    assert tags == {"WS002", "WS004"}


def test_empty_segments_are_not_written(spark, tmp_path):
    register = Register.of(table(spark, MOBILE_HEADERS, MOBILE_ROWS))
    spec = FilterSpec(replacement_models=["Phone Z"], search="nowhere")
    folders = dashboard(register, spec, AS_OF).export(str(tmp_path), DAY)
    assert set(folders) == {"all"}
    assert spark.read.parquet(folders["all"]).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        dashboard(register, spec, AS_OF).export(str(tmp_path), DAY)


def test_headers_that_clash_keep_column_names(spark, tmp_path):
    register = Register.of(table(spark, ["Model", "model"], [("a", "b")]))
    assert with_typed_headers(register).columns == ["model", "model_2"]
    write_export(register, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).first() == ("a", "b")


def odd_register(spark):
    rows = [("m1", "", None), (" m2 ", 'say "x"', "a,b"), ("m3", "two\nlines", "é"), (None, None, None)]
    return Register.of(spark.createDataFrame(rows, "Model string, `Asset Tag` string, Place string"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_committed_exports(spark, tmp_path, fmt):
    register = odd_register(spark)
    folder = str(tmp_path / "out")
    manifest = exports.commit_export(register, folder, fmt)
    assert manifest["rows"] == 4 and exports.read_manifest(spark, folder) == manifest
    back = exports.read_export(spark, folder)
    assert back.columns == ["Model", "Asset Tag", "Place"]
    expected = [tuple((v or None) if fmt == "csv" else v for v in r) for r in register.df.collect()]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(expected, key=repr)
    assert exports.content_digest(back) == (manifest["rows"], manifest["digest"])
    with pytest.raises(FileExistsError):
        exports.commit_export(register, folder, fmt)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    broken = odd_register(spark)
    broken = broken.with_rows(broken.df.selectExpr("*", "raise_error(model) AS broken"))
    with pytest.raises(Exception, match="m1|m2|m3|null"):
        exports.commit_export(broken, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, str(tmp_path / "out"))


def test_the_digest_tells_rows_apart(spark):
    rows = odd_register(spark).df
    assert exports.content_digest(rows) == exports.content_digest(rows.repartition(3).orderBy("place"))
    for other in (rows.where("model <> 'm1'"), rows.na.fill("x"), rows.union(rows.limit(1))):
        assert exports.content_digest(other) != exports.content_digest(rows)


def test_committed_names(spark, tmp_path):
    register = Register.of(table(spark, WORKSTATION_HEADERS, WORKSTATION_ROWS))
    folders = exports.commit_exports(str(tmp_path), register, register.where(register.col("model") == "zzz"), None, DAY)
    assert {k: v.rsplit("/", 1)[1] for k, v in folders.items()} == {"all": "workstation_assets_20250615"}
