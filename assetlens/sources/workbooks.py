"""Bulk ingest of .xlsx workbooks: triage, sheet lists and grids of cells."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.sources.cells import Workbook
from assetlens.sources.listing import listed_files

ZIP_MAGIC = b"PK"
ROWS_PER_BATCH = 4096

SHEETS = pa.schema(
    [
        ("path", pa.string()),
        ("sheet_no", pa.int32()),
        ("sheet", pa.string()),
        ("error", pa.string()),
    ]
)
GRID = pa.schema(
    [
        ("path", pa.string()),
        ("sheet", pa.string()),
        ("pos", pa.int64()),
        ("width", pa.int32()),
        ("cells", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)
SHEETS_DDL = "path string, sheet_no int, sheet string, error string"
GRID_DDL = (
    "path string, sheet string, pos bigint, width int, cells array<string>, error string"
)
GRID_COLUMNS = ["path", "sheet", "pos", "width", "cells"]


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under `path` as `path, length, content`.

    The scan packs files by size (`spark.sql.files.maxPartitionBytes`), so a task holds about
    128 MB of workbooks or one larger file; no shuffle of file contents is needed.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def uploads(spark: SparkSession, path: str, levels: int = 1) -> DataFrame:
    """All files under `path` as `path, length, head`, those without content too, for `triage`."""
    return listed_files(spark, path, levels)


def is_zip(content: Column) -> Column:
    """Whether file content starts like a zip archive."""
    return F.coalesce(F.substring(content, 1, len(ZIP_MAGIC)) == F.lit(ZIP_MAGIC), F.lit(False))


def triage(files: DataFrame) -> DataFrame:
    """Per file (`uploads`, or files with their `content`), whether it can be a workbook at all.

    Files without content are no workbooks either; of `uploads` they are listed as such.
    """
    start = F.col("head" if "head" in files.columns else "content")
    return files.select("path", "length", is_zip(start).alias("accepted"))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch(
        [pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)], schema=schema
    )


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield path.as_py(), content.as_py()


def _sheet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, content in _files(batches):
        try:
            names = [name for name, _ in Workbook(io.BytesIO(content)).sheets]
            rows = [(path, number, name, None) for number, name in enumerate(names)]
        except Exception as error:  # one bad file must not end the job
            rows = [(path, None, None, f"{type(error).__name__}: {error}")]
        yield _batch(SHEETS, rows)


def _grid_rows(path: str, content: bytes) -> Iterator[tuple]:
    try:
        workbook = Workbook(io.BytesIO(content))
    except Exception as error:
        yield path, None, None, None, None, f"{type(error).__name__}: {error}"
        return
    for name, member in workbook.sheets:
        try:
            for position, cells in workbook.rows(member):
                yield path, name, position, len(cells), cells, None
        except Exception as error:
            yield path, name, None, None, None, f"{type(error).__name__}: {error}"


def _grid_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    for path, content in _files(batches):
        for row in _grid_rows(path, content):
            pending.append(row)
            if len(pending) == ROWS_PER_BATCH:
                yield _batch(GRID, pending)
                pending = []
    if pending:
        yield _batch(GRID, pending)


def sheet_list(files: DataFrame) -> DataFrame:
    """Sheets of every workbook in their order, or why it could not be opened."""
    workbooks = files.where(is_zip(F.col("content"))).select("path", "content")
    return workbooks.mapInArrow(_sheet_batches, SHEETS_DDL)


def raw_grid(files: DataFrame) -> DataFrame:
    """Rows of all sheets, and one row with `error` per sheet or file that cannot be read.

    Every workbook is read within one task, sheet by sheet and row by row. The format bounds a
    sheet at 1,048,576 rows. Write the result to a table before using it more than once.
    """
    workbooks = files.where(is_zip(F.col("content"))).select("path", "content")
    return workbooks.mapInArrow(_grid_batches, GRID_DDL)


def read_errors(raw: DataFrame) -> DataFrame:
    """What could not be read, and why."""
    return raw.where(F.col("error").isNotNull()).select("path", "sheet", "error")


def readable_grid(raw: DataFrame) -> DataFrame:
    """Rows of the sheets that were read to their end; a broken sheet is left out whole."""
    broken = read_errors(raw).where(F.col("sheet").isNotNull()).select("path", "sheet")
    rows = raw.where(F.col("error").isNull()).select(*GRID_COLUMNS)
    return rows.join(broken, ["path", "sheet"], "left_anti")
