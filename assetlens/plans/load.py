"""One sheet of a grid as a register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.errors import SeveralWorkbooks, SheetNotFound
from assetlens.functions.text import without_markers
from assetlens.operators.headers import checked_manual_row, register_table
from assetlens.plans.register import Register
from assetlens.session import staged
from assetlens.sources.workbooks import raw_grid, readable_grid, sheet_list, workbook_files


def load_sheet(
    grid: DataFrame, path: str, sheet: str, header_row: int | None = None
) -> Register:
    """Promote the header of one sheet and resolve its columns.

    Only the header's names come to the driver. `header_row` overrides the detected row.
    """
    rows = grid.where((F.col("path") == path) & (F.col("sheet") == sheet))
    overrides = None
    if header_row is not None:
        overrides = grid.sparkSession.range(1).select(
            F.lit(path).alias("path"),
            F.lit(sheet).alias("sheet"),
            F.lit(checked_manual_row(header_row)).alias("header_row"),
        )
    found = register_table(rows, overrides).select("header_row", "columns").first()
    if found is None:
        raise SheetNotFound(f"no rows for sheet {sheet!r} of {path}")
    data = rows.where(F.col("pos") > found["header_row"])
    columns = found["columns"]
    values = data.select(
        *[
            without_markers(F.get("cells", F.lit(c["col"]))).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return Register.of(values.toDF(*[c["name"] for c in columns]))


def open_workbook(
    spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None
) -> Register:
    """One sheet of one workbook, by default the first, as a register.

    The workbook is parsed once; its grid is kept for the results to come.
    """
    files = workbook_files(spark, path)
    if files.select("path").limit(2).count() > 1:
        raise SeveralWorkbooks(f"{path} holds more than one workbook; open them one by one")
    sheets = sheet_list(files).where(F.col("sheet").isNotNull()).orderBy("sheet_no").collect()
    names = [row["sheet"] for row in sheets]
    if not names or (sheet is not None and sheet not in names):
        raise SheetNotFound(f"{path} has sheets {names}, wanted {sheet!r}")
    grid = readable_grid(staged(raw_grid(files)))
    return load_sheet(grid, sheets[0]["path"], sheet or names[0], header_row)
