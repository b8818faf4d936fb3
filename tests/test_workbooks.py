"""Workbook files: triage, sheets, cells, and one workbook as a register."""

import io
import zipfile

import pytest

from assetlens import open_workbook
from assetlens.checks.packing import pack_workbook
from assetlens.errors import SheetNotFound
from assetlens.sources import workbooks
from assetlens.sources.listing import listed_files
from assetlens.sources.cells import column_index, is_date_format, moment_text
from templates import WORKSTATION_HEADERS, WORKSTATION_ROWS

ASSETS = [
    ["Register", None, None],
    [],
    ["Asset Tag", "Model", "User", "Warranty Expiry", "Year Of Purchase"],
    ["A1", "M & <1>", "Ann", 45992, 2022],
    [],
    ["A2", "M2", None, 45992.5, 2021.5],
    [None, None, None, None, None],
]


def replaced(content, member, old, new):
    """A workbook with a changed member."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(buffer, "w") as target:
        for name in source.namelist():
            data = source.read(name)
            target.writestr(name, data.replace(old, new) if name == member else data)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("workbooks")
    for shared in (True, False):
        sheets = {"Assets": ASSETS, "Flags & more": [[True, False, 7, None, 1.25, "x"]], "Empty": []}
        content = pack_workbook(sheets, shared=shared, date_columns={3})
        (path / f"shared_{shared}.xlsx").write_bytes(content)
    (path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (path / "empty.xlsx").write_bytes(b"")
    (path / "truncated.xlsx").write_bytes(content[: len(content) // 2])
    broken = pack_workbook({"Good": [["a"]], "Bad": [["b"], ["c"]]})
    broken = replaced(broken, "xl/worksheets/sheet2.xml", b"</sheetData>", b"<oops>")
    (path / "half.xlsx").write_bytes(broken)
    return str(path)


@pytest.fixture(scope="module")
def files(spark, folder):
    return workbooks.workbook_files(spark, folder)


def by_name(df):
    out: dict = {}
    for row in df.collect():
        out.setdefault(row["path"].rsplit("/", 1)[-1], []).append(row)
    return out


def test_triage(files):
    accepted = {n: rows[0]["accepted"] for n, rows in by_name(workbooks.triage(files)).items()}
    assert accepted == {
        "shared_True.xlsx": True, "shared_False.xlsx": True, "old.xls": False,
        "truncated.xlsx": True, "half.xlsx": True,
    }


def test_triage_lists_empty_files(spark, folder, tmp_path):
    rows = by_name(workbooks.triage(workbooks.uploads(spark, folder)))
    assert {n: [(r["length"] > 0, r["accepted"]) for r in found] for n, found in rows.items()} == {
        "shared_True.xlsx": [(True, True)], "shared_False.xlsx": [(True, True)], "old.xls": [(True, False)],
        "truncated.xlsx": [(True, True)], "half.xlsx": [(True, True)], "empty.xlsx": [(False, False)],
    }
    (tmp_path / "a b%20+é.xlsx").write_bytes(b"PK")
    (tmp_path / "none é+.xlsx").write_bytes(b"")
    rows = workbooks.triage(workbooks.uploads(spark, str(tmp_path))).collect()
    assert sorted((r["path"].rsplit("/", 1)[-1], r["accepted"]) for r in rows) == [("a b%20+é.xlsx", True), ("none é+.xlsx", False)]


@pytest.mark.parametrize("levels", [0, 1, 2, 5])
def test_files_in_folders_of_folders(spark, tmp_path, levels):
    """Every file comes once, however deep it lies and however many levels are split into tasks."""
    expected = {}
    for number, folder in enumerate(["", "a", "a/b", "a/b/c", "d", "e f/é"]):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for name, content in (("x.xlsx", b"PK\x03\x04rest"), ("y", b""), (f"z{number}", b"ab")):
            (tmp_path / folder / name).write_bytes(content)
            expected[f"file:{tmp_path / folder / name}"] = (len(content), content[:4])
    rows = listed_files(spark, str(tmp_path), levels).collect()
    assert {r["path"]: (r["length"], bytes(r["head"])) for r in rows} == expected and len(rows) == len(expected)
    scanned = {r["path"] for r in workbooks.workbook_files(spark, str(tmp_path)).select("path").collect()}
    assert {r["path"] for r in rows if r["length"]} == scanned


def test_sheets(files):
    sheets = by_name(workbooks.sheet_list(files))
    assert [r["sheet"] for r in sheets["shared_True.xlsx"]] == ["Assets", "Flags & more", "Empty"]
    assert sheets["truncated.xlsx"][0]["error"].startswith("BadZipFile")
    assert "old.xls" not in sheets


@pytest.mark.parametrize("name", ["shared_True.xlsx", "shared_False.xlsx"])
def test_cells(files, name):
    rows = by_name(workbooks.readable_grid(workbooks.raw_grid(files)))[name]
    assets = {r["pos"]: r["cells"] for r in rows if r["sheet"] == "Assets"}
    assert assets == {
        0: ["Register"],
        1: [],
        2: ASSETS[2],
        3: ["A1", "M & <1>", "Ann", "2025-12-01 00:00:00", "2022"],
        4: [],
        5: ["A2", "M2", None, "2025-12-01 12:00:00", "2021.5"],
    }
    flags = [r["cells"] for r in rows if r["sheet"] == "Flags & more"]
    assert flags == [["True", "False", "7", None, "1.25", "x"]]


def test_a_broken_sheet_is_left_out_whole(files):
    raw = workbooks.raw_grid(files)
    errors = by_name(workbooks.read_errors(raw))
    assert set(errors) == {"truncated.xlsx", "half.xlsx"}
    assert [r["sheet"] for r in errors["half.xlsx"]] == ["Bad"]
    rows = by_name(workbooks.readable_grid(raw))
    assert [r["sheet"] for r in rows["half.xlsx"]] == ["Good"]
    assert "truncated.xlsx" not in rows


def test_open_workbook(spark, folder):
    register = open_workbook(spark, f"{folder}/shared_True.xlsx")
    assert register.kind == "Workstation"
    assert register.roles["warranty_expiry"] == "warranty_expiry"
    rows = register.df.orderBy("asset_tag").collect()
    assert [r["user"] for r in rows] == [None, "Ann", None]
    with pytest.raises(SheetNotFound):
        open_workbook(spark, f"{folder}/shared_True.xlsx", sheet="Nope")


def test_a_template_survives(spark, tmp_path):
    path = tmp_path / "template.xlsx"
    path.write_bytes(
        pack_workbook({"Workstation Assets": [WORKSTATION_HEADERS, *WORKSTATION_ROWS]})
    )
    register = open_workbook(spark, str(path))
    assert list(register.headers.values()) == WORKSTATION_HEADERS
    assert sorted(map(tuple, register.df.collect())) == WORKSTATION_ROWS


def test_columns_beyond_z():
    assert [column_index(r) for r in ("A", "Z", "AA", "AZ", "BA", "XFD")] == [
        0, 25, 26, 51, 52, 16383,
    ]


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ("yyyy\\-mm\\-dd", True),
        ("[$-409]d/m/yy h:mm AM/PM;@", True),
        ("0.00", False),
        ("#,##0;[Red]-#,##0", False),
        ('0 "days"', False),
        ("General", False),
        ("@", False),
    ],
)
def test_date_formats(code, expected):
    assert is_date_format(code) == expected


def test_serials():
    from datetime import datetime

    since_1900, since_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
    assert moment_text(45992.0, since_1900) == "2025-12-01 00:00:00"
    assert moment_text(1.0, since_1900) == "1900-01-01 00:00:00"
    assert moment_text(59.0, since_1900) == "1900-02-28 00:00:00"
    assert moment_text(61.0, since_1900) == "1900-03-01 00:00:00"
    assert moment_text(0.5, since_1900) == "12:00:00"
    assert moment_text(0.0 + 366, since_1904) == "1905-01-01 00:00:00"
