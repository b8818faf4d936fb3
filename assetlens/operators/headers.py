"""From raw grids to tables with named columns, for many registers at once.

A grid has one row per sheet row: `path, sheet, pos, cells`, positions counted from 0. A stored
grid should also have `width`, the number of cells: then their values need not be read for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.errors import HeaderRowError
from assetlens.functions.text import without_markers
from assetlens.operators.roles import ROLES, with_roles

# Words that give a header row away, how many cells must hold one, how many
# rows are looked at, and the last row a person may name.
HEADER_KEYWORDS = [
    "model",
    "serial",
    "user",
    "department",
    "asset",
    "workstation",
    "location",
    "site",
    "computer",
    "employee",
    "email",
    "product",
    "mobile",
    "programme",
    "program",
]
HEADER_MATCHES = 3
PREVIEW_ROWS = 15
LAST_MANUAL_ROW = 20

KEYS = ["path", "sheet"]
ROWS_PER_SLICE = 100_000


def looks_like_header(cells: Column) -> Column:
    """Whether enough cells of a row hold a keyword."""
    pattern = "|".join(HEADER_KEYWORDS)
    hits = F.filter(cells, lambda v: F.coalesce(F.lower(v).rlike(pattern), F.lit(False)))
    return F.size(hits) >= HEADER_MATCHES


def detect_header_rows(grid: DataFrame) -> DataFrame:
    """Position of the first row that looks like a header; 0 where none does.

    Only the preview rows have their cells read. The other branch reads the keys alone, so that
    every register is present in the result; both meet in one aggregation.
    """
    hits = (
        grid.where(F.col("pos") < PREVIEW_ROWS)
        .where(looks_like_header(F.col("cells")))
        .select(*KEYS, F.col("pos").cast("bigint").alias("pos"))
    )
    every = grid.select(*KEYS, F.lit(None).cast("bigint").alias("pos"))
    return (
        hits.unionByName(every)
        .groupBy(*KEYS)
        .agg(F.coalesce(F.min("pos"), F.lit(0).cast("bigint")).alias("header_row"))
    )


def checked_manual_row(row: int) -> int:
    """`row`, or an error where it lies outside what a person may choose."""
    if not 0 <= row <= LAST_MANUAL_ROW:
        raise HeaderRowError(f"header row {row} is not within 0..{LAST_MANUAL_ROW}")
    return row


def override_header_rows(detected: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace detected positions by the manual ones of `overrides(path, sheet, header_row)`.

    A manual position outside 0..20 is ignored and flagged; other columns stay. Both tables hold
    one row per register; whether the smaller one is broadcast is left to its size.
    """
    manual = overrides.select(*KEYS, F.col("header_row").cast("bigint").alias("manual"))
    valid = F.col("manual").between(0, LAST_MANUAL_ROW)
    others = [c for c in detected.columns if c != "header_row"]
    return detected.join(manual, KEYS, "left").select(
        *others,
        F.when(valid, F.col("manual")).otherwise(F.col("header_row")).alias("header_row"),
        F.coalesce(valid, F.lit(False)).alias("is_manual"),
        F.coalesce(~valid, F.lit(False)).alias("is_rejected"),
    )


# ------------------------------------------------------------------------ names

# The `width` columns under the header cells `cells`, as an array of (col, name, blank). A blank cell is
# named after its position.
HEADER_ENTRIES = """
transform(sequence(0, width - 1), i -> named_struct(
    'col', i,
    'name', if(coalesce(get(cells, i), '') = '', concat('Unnamed: ', i), get(cells, i)),
    'blank', coalesce(get(cells, i), '') = ''))
"""
# What a name looks like that might have been given to a repeat: a stem and a number without leading zeros.
NUMBERED = r"(?s)^(.*)\.([1-9][0-9]{0,17})\z"
TRIMMED = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def trimmed(name: Column) -> Column:
    """A name without white space around it."""
    return F.regexp_replace(name, TRIMMED, "")


def naming_events(entries: Column) -> Column:
    """Of an array of HEADER_ENTRIES, an array of (key, taken, number, col, blank): what its naming needs.

    Every column asks for a name (`taken` 0) like its own; one that looks numbered takes that number
    from its stem (`taken` 1).
    """

    def event(key: Column, number: Column | None, entry: Column) -> Column:
        asks = number is None
        return F.struct(
            key.alias("key"),
            F.lit(0 if asks else 1).alias("taken"),
            (F.lit(None).cast("bigint") if asks else number).alias("number"),
            (entry["col"] if asks else F.lit(None).cast("int")).alias("col"),
            (entry["blank"] if asks else F.lit(None).cast("boolean")).alias("blank"),
        )

    def of(entry: Column) -> Column:
        number = F.regexp_extract(entry["name"], NUMBERED, 2).try_cast("bigint")
        takes = event(F.regexp_extract(entry["name"], NUMBERED, 1), number, entry)
        asks = event(entry["name"], None, entry)
        return F.when(number.isNotNull(), F.array(asks, takes)).otherwise(F.array(asks))

    return F.flatten(F.transform(entries, of))


def numbered(events: DataFrame) -> DataFrame:
    """The events that ask for a name, with `name`, unlike all others of the same keys.

    Of equal names the first typed one stays, or else the first; each repeat gets the stem with the
    first number that is neither typed by someone nor given to a repeat before. As a number has no dot, a name
    given to a repeat of one stem is never one of another: so stems are numbered apart.

    The j-th repeat's number is j and as many more as there are taken numbers up to it. The i-th smallest
    taken number t pushes on all repeats from t - i + 1; so repeats and taken numbers are sorted
    together, and each repeat counts the taken ones up to its place. All is sorting and counting after one
    exchange, linear but for the sort, however many equal names there are.
    """
    stem = [*KEYS, "key"]
    in_order = Window.partitionBy(*stem, "taken").orderBy("number", "blank", "col")
    again = (F.col("taken") == 1) & F.lag("number").over(in_order).eqNullSafe(F.col("number"))
    once = events.repartition(*stem).withColumn("again", again).where("NOT again").drop("again")
    nth = F.row_number().over(in_order)
    place = F.when(F.col("taken") == 1, F.col("number") - nth + 1).otherwise(nth - 1).cast("bigint")
    so_far = (
        Window.partitionBy(*stem)
        .orderBy("place", F.desc("taken"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = once.withColumn("place", place).withColumn("number", F.col("place") + F.sum("taken").over(so_far))
    suffix = F.concat("key", F.lit("."), F.col("number").cast("string"))
    name = F.when(F.col("place") == 0, F.col("key")).otherwise(suffix)
    return counted.where("taken = 0").withColumn("name", name).drop("taken", "number", "blank", "place")


def with_clean_columns(headed: DataFrame) -> DataFrame:
    """`headed` (keys, cells, width, ...) with `columns`, an array of (col, name), for `cells` and `width`.

    Names are made unlike, then trimmed, and of equal trimmed ones the first column stays. Registers whose names
    all differ, trimmed ones too, are named in place and pass through as one row. Only the others are
    taken apart into rows per column, named, and brought together again.
    """
    others = [c for c in headed.columns if c not in ("cells", "width")]
    entries = headed.select(*others, F.expr(HEADER_ENTRIES).alias("entries"))
    in_place = F.transform("entries", lambda e: F.struct(e["col"].alias("col"), trimmed(e["name"]).alias("name")))
    known = entries.withColumn("columns", in_place)
    alike = F.size(F.array_distinct(F.transform("columns", lambda c: c["name"]))) < F.size("columns")
    nothing = F.struct(
        F.lit(None).cast("string").alias("key"), F.lit(0).alias("taken"), F.lit(None).cast("bigint").alias("number"),
        F.lit(None).cast("int").alias("col"), F.lit(None).cast("boolean").alias("blank"),
    )
    events = F.when(alike, naming_events(F.col("entries"))).otherwise(F.array(nothing))
    apart = known.select(*others, F.when(~alike, F.col("columns")).alias("columns"), F.inline(events))
    named = numbered(apart).withColumn("name", trimmed(F.col("name")))
    first = Window.partitionBy(*KEYS, "name").orderBy("col")
    kept = named.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    listed = F.sort_array(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "name"))))
    columns = F.coalesce(F.first("columns", True), listed).alias("columns")
    rest = [F.first(c).alias(c) for c in others if c not in KEYS]
    return kept.groupBy(*KEYS).agg(*rest, columns).select(*others, "columns")


# --------------------------------------------------------------------- registers


def register_table(grid: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per register: header position, cleaned columns, last position.

    Cells are read of the first rows only, of which a register has at most 21; of the others the
    positions and widths. Both parts are aggregated per register before they meet.
    """
    width = F.col("width") if "width" in grid.columns else F.size("cells")
    extent = grid.groupBy(*KEYS).agg(
        F.max(width).alias("width"), F.max("pos").cast("bigint").alias("last_pos")
    )
    hit = (F.col("pos") < PREVIEW_ROWS) & looks_like_header(F.col("cells"))
    preview = (
        grid.where(F.col("pos") <= LAST_MANUAL_ROW)
        .groupBy(*KEYS)
        .agg(
            F.min(F.when(hit, F.col("pos"))).cast("bigint").alias("detected"),
            F.collect_list(F.struct("pos", "cells")).alias("preview"),
        )
    )
    found = F.coalesce("detected", F.lit(0).cast("bigint"))
    summary = extent.join(preview, KEYS, "left").withColumn("header_row", found)
    if overrides is not None:
        summary = override_header_rows(summary, overrides)
    header = F.expr("get(filter(preview, p -> p.pos = header_row), 0).cells")
    headed = summary.select(
        *KEYS,
        "header_row",
        "last_pos",
        F.greatest("width", F.lit(1)).alias("width"),
        header.alias("cells"),
    )
    return with_clean_columns(headed)


def column_catalogue(registers: DataFrame) -> DataFrame:
    """Every column of every register, numbered from 1, with the total."""
    return registers.select(
        *KEYS,
        F.size("columns").alias("total_columns"),
        F.posexplode("columns").alias("ordinal", "column"),
    ).select(
        *KEYS,
        (F.col("ordinal") + 1).alias("ordinal"),
        F.col("column.name").alias("name"),
        "total_columns",
    )


def data_rows(grid: DataFrame, registers: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Grid rows below the header, each with its register's row.

    A register is cut into slices of consecutive positions, and its one row is repeated per
    slice. So the join key never holds more than `rows_per_slice` grid rows, however large a
    register is, and the repeats number at most rows / rows_per_slice + registers. Whether the
    registers are broadcast is left to their size.
    """
    slice_of = F.expr(f"int(pos div {rows_per_slice})")
    # An outer explode, because an inner one would have its long input repeated as a filter.
    slices = F.expr(f"explode_outer(sequence(0, int(last_pos div {rows_per_slice})))")
    sliced = registers.withColumn("slice", slices).drop("last_pos")
    return (
        grid.withColumn("slice", slice_of)
        .join(sliced, [*KEYS, "slice"])
        .where(F.col("pos") > F.col("header_row"))
        .drop("slice")
    )


def promote_headers(
    grid: DataFrame, registers: DataFrame, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Data cells under their column names, one row per cell: path, sheet, pos, name, value."""
    column_only = registers.select(*KEYS, "header_row", "last_pos", "columns")
    rows = data_rows(grid, column_only, rows_per_slice)
    named = F.transform(
        "columns",
        lambda c: F.struct(
            c["name"].alias("name"),
            without_markers(F.get("cells", c["col"])).alias("value"),
        ),
    )
    return rows.select(*KEYS, F.col("pos").cast("bigint").alias("pos"), F.inline(named))


def canonical_rows(
    grid: DataFrame,
    registers: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
    with_present: bool = False,
) -> DataFrame:
    """All usable registers as one table under role names; `with_present` adds `present`, the roles a register has.

    Registers without a model column are left out; `missing_model` lists them. `cells` keeps
    the values of all columns, for searches and exports. Give a stored table of registers where
    there are many: knowing its size beforehand, Spark need not shuffle the grid for a small one.
    """
    # Without a last position a register has no slices, hence no rows.
    usable = F.when(F.col("roles.model.col").isNotNull(), F.col("last_pos"))
    slim = with_roles(registers).select(
        *KEYS,
        "header_row",
        usable.alias("last_pos"),
        "asset_type",
        F.transform("columns", lambda c: c["col"]).alias("cols"),
        *[F.col(f"roles.{role}.col").alias(f"at_{role}") for role in ROLES],
    )
    has = F.array_compact(F.array(*[F.when(F.col(f"at_{role}").isNotNull(), F.lit(role)) for role in ROLES]))
    extra = [has.alias("present")] if with_present else []
    present = F.transform("cells", without_markers)
    rows = data_rows(grid, slim, rows_per_slice).withColumn("cells", present)
    return rows.select(
        *KEYS,
        F.col("pos").cast("bigint").alias("pos"),
        "asset_type",
        *[F.expr(f"get(cells, at_{role})").alias(role) for role in ROLES],
        F.expr("transform(cols, i -> get(cells, i))").alias("cells"),
        *extra,
    )
