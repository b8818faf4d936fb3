"""Header detection, manual rows, promotion and names of columns."""

import io
import itertools
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlens.errors import HeaderRowError, SheetNotFound
from assetlens.operators import headers
from assetlens.plans.load import load_sheet

HEADER = ["Asset Tag", "Model", "User"]


def grid(spark, sheets):
    """`sheets` maps a path to its rows of cells."""
    rows = [
        (path, "Assets", pos, cells)
        for path, cells_by_row in sheets.items()
        for pos, cells in enumerate(cells_by_row)
    ]
    return spark.createDataFrame(
        rows, "path string, sheet string, pos bigint, cells array<string>"
    )


def detected(spark, sheets):
    df = headers.detect_header_rows(grid(spark, sheets))
    found = {r["path"]: r["header_row"] for r in df.collect()}
    table = headers.register_table(grid(spark, sheets))
    assert {r["path"]: r["header_row"] for r in table.collect()} == found
    return found


def test_detection(spark):
    assert detected(
        spark,
        {
            "first": [HEADER, ["a", "b", "c"]],
            "fifth": [["Title"], [], ["x"], [None], [" ASSET ", "xMODELx", "Users"], HEADER],
            "two hits": [["Title"], ["Asset Tag", "Model", "Name"], ["a", "b", "c"]],
            "none": [["Title"], ["a", "b", "c"]],
            "at 14": [["t"]] * 14 + [HEADER],
            "at 15": [["t"]] * 15 + [HEADER],
            # Cells count, not keywords: one cell with three of them is one.
            "one cell": [["Asset Model User", "x"], ["y"]],
            "program twice": [["programme", "program", "program x"], ["y"]],
        },
    ) == {
        "first": 0, "fifth": 4, "two hits": 0, "none": 0, "at 14": 14, "at 15": 0,
        "one cell": 0, "program twice": 0,
    }


def test_overrides(spark):
    found = spark.createDataFrame(
        [(p, "Assets", 2) for p in "abc"], "path string, sheet string, header_row bigint"
    )
    manual = spark.createDataFrame(
        [("a", "Assets", 20), ("b", "Assets", 21), ("z", "Assets", 1)],
        "path string, sheet string, header_row int",
    )
    rows = headers.override_header_rows(found, manual).collect()
    assert {r["path"]: tuple(r)[2:] for r in rows} == {
        "a": (20, True, False), "b": (2, False, True), "c": (2, False, False),
    }


def names_of(spark, header_rows):
    """Names before trimming, per header row."""
    rows = [(str(i), "s", h, len(h)) for i, h in enumerate(header_rows)]
    df = spark.createDataFrame(rows, "path string, sheet string, cells array<string>, width int")
    events = df.select("path", "sheet", F.inline(headers.naming_events(F.expr(headers.HEADER_ENTRIES))))
    found: dict = {}
    for row in headers.numbered(events).collect():
        found.setdefault(int(row["path"]), {})[row["col"]] = row["name"]
    return {i: [names[col] for col in sorted(names)] for i, names in found.items()}


def test_repeated_names_agree_with_pandas(spark):
    rng = random.Random(5)
    words = ["X", "X.1", "X.2", "X.1.1", "Y", "Unnamed: 1", "Unnamed: 2", ""]
    rows = [rng.choices(words, k=rng.randint(1, 8)) for _ in range(400)]
    rows += [["X", "X.1", "X"], ["X", "X", "X.1"], ["", "", ""], ["Unnamed: 1", "", "X"]]
    found = names_of(spark, rows)
    for i, row in enumerate(rows):
        text = ",".join(row) + "\n" + ",".join("0" * len(row)) + "\n"
        if not any(row):  # a blank line is no header to pandas
            text = ",".join(f'"{c}"' for c in row) + "\n" + ",".join("0" * len(row)) + "\n"
        expected = pd.read_csv(io.StringIO(text), engine="python", skip_blank_lines=False).columns
        assert found[i] == list(expected), row


def test_thousands_of_equal_headers(spark):
    """Repeats are numbered by sorting; numbers that others have typed are passed over."""
    typed = [f"X.{k}" for k in range(2, 4000, 3)]
    cells = ["X"] * 5000 + typed + ["Y", "", "X.007"]
    start = time.monotonic()
    table = headers.register_table(grid(spark, {"p": [cells, ["a"]], "q": [HEADER, ["a"]]}))
    columns = {r["path"]: [c["name"] for c in r["columns"]] for r in table.collect()}
    assert time.monotonic() - start < 30
    free = (f"X.{k}" for k in range(1, 10**6) if f"X.{k}" not in set(typed))
    expected = ["X", *itertools.islice(free, 4999), *typed, "Y", f"Unnamed: {len(cells) - 2}", "X.007"]
    assert columns == {"p": expected, "q": HEADER}


def test_trimmed_names_are_kept_once(spark):
    table = headers.register_table(
        grid(spark, {"p": [[" Asset Tag", "Model", "Model", "Asset Tag ", " User\t"], ["a"]]})
    )
    columns = table.first()["columns"]
    assert [(c["col"], c["name"]) for c in columns] == [
        (0, "Asset Tag"), (1, "Model"), (2, "Model.1"), (4, "User"),
    ]


def test_width_is_that_of_the_widest_row(spark):
    table = headers.register_table(grid(spark, {"p": [HEADER, ["a", "b", "c", "d", "e"]]}))
    assert [c["name"] for c in table.first()["columns"]] == [*HEADER, "Unnamed: 3", "Unnamed: 4"]


def test_load_sheet(spark):
    rows = grid(
        spark,
        {
            "p": [
                ["Printout", None, "x"],
                ["Model", "Model", "User", "Warranty Expiry"],
                ["m1", "m2", "N/A", "2025-01-01"],
                [],
                ["m3", "", "u"],
            ]
        },
    )
    register = load_sheet(rows, "p", "Assets")
    assert register.df.columns == ["model", "model_1", "user", "warranty_expiry"]
    assert sorted(map(tuple, register.df.collect()), key=str) == [
        ("m1", "m2", None, "2025-01-01"), ("m3", None, "u", None), (None, None, None, None),
    ]
    with pytest.raises(HeaderRowError):
        load_sheet(rows, "p", "Assets", header_row=21)
    with pytest.raises(SheetNotFound):
        load_sheet(rows, "p", "Other")


def test_manual_header_row_of_a_sheet(spark):
    rows = grid(spark, {"p": [HEADER, ["Model X", "y", "z"], ["a", "b", "c"]]})
    register = load_sheet(rows, "p", "Assets", header_row=1)
    assert list(register.headers.values()) == ["Model X", "y", "z"]
    assert [tuple(r) for r in register.df.collect()] == [("a", "b", "c")]


def test_slices_change_nothing(spark, small):
    from assetlens.checks import derived as inputs

    cells = inputs.grid(spark, small)
    table = headers.register_table(cells)
    whole = headers.canonical_rows(cells, table).drop("cells")
    sliced = headers.canonical_rows(cells, table, rows_per_slice=5).drop("cells")
    assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect()))
    assert whole.count() > 1000


def test_a_large_register_is_spread_when_it_is_shuffled(spark):
    """A hot register of 4000 rows, joined by shuffle: no key holds more than a slice."""
    rows = spark.range(1, 4001).select(
        F.lit("hot").alias("path"),
        F.lit("Assets").alias("sheet"),
        F.col("id").alias("pos"),
        F.array(F.col("id").cast("string"), F.lit("m"), F.lit("u")).alias("cells"),
    )
    cells = rows.unionByName(grid(spark, {"hot": [HEADER], "cold": [HEADER, ["1", "m", "u"]]}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = headers.register_table(cells)
        found = headers.canonical_rows(cells, table, rows_per_slice=100)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(path" in text and "BroadcastHashJoin" not in text
        assert {int(r["asset_tag"]) for r in found.where("path = 'hot'").collect()} == set(
            range(1, 4001)
        )
        joined = headers.data_rows(cells, table.select("path", "sheet", "header_row", "last_pos"), 100)
        assert joined.count() == 4001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
