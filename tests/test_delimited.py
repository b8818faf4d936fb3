"""Delimited text: positions of lines across splits and files."""

import csv
import random

import pytest

from assetlens.operators.headers import register_table
from assetlens.sources.delimited import delimited_grid, numbered_lines


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "500")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_positions_across_splits(spark, small_splits, tmp_path):
    rng = random.Random(3)
    texts = {}
    for name, count in (("a.csv", 3000), ("b.csv", 1), ("c.csv", 700), ("d.csv", 40)):
        lines = [
            "" if rng.random() < 0.1 else f"{name} {i} " + "x" * rng.randint(0, 60)
            for i in range(count)
        ]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        texts[name] = lines
    lines = numbered_lines(spark, str(tmp_path))
    found: dict = {}
    for row in lines.collect():
        found.setdefault(row["path"].rsplit("/", 1)[-1], {})[row["pos"]] = row["value"]
    for name, expected in texts.items():
        assert found[name] == dict(enumerate(expected))


def test_grid(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        'Register printout\n\nAsset Tag,Model,User\nA1,"M, one",Ann\nA2,,\n\nA3,"say ""x""", b \n'
    )
    rows = delimited_grid(spark, str(tmp_path / "r.csv"))
    cells = {r["pos"]: r["cells"] for r in rows.collect()}
    assert cells[0] == ["Register printout"]
    assert cells[1] == [] and cells[5] == []
    assert cells[3] == ["A1", "M, one", "Ann"]
    assert cells[4] == ["A2"]
    assert cells[6][2] == " b "
    assert register_table(rows).first()["header_row"] == 2


def test_lines_of_differing_width_keep_all_cells(spark, tmp_path):
    (tmp_path / "w.csv").write_text('A,B,C,D,E5\nx\n"a ""q"" b",,"c,d",\n,,,,,,last\n')
    rows = delimited_grid(spark, str(tmp_path / "w.csv")).collect()
    cells = {r["pos"]: r["cells"] for r in rows}
    assert cells == {
        0: ["A", "B", "C", "D", "E5"],
        1: ["x"],
        2: ['a "q" b', None, "c,d"],
        3: [None] * 6 + ["last"],
    }


csv.field_size_limit(10**9)


def read_plainly(path, separator=","):
    with open(path, newline="") as file:
        rows = [[cell or None for cell in row] for row in csv.reader(file, delimiter=separator)]
    for row in rows:
        while row and row[-1] is None:
            row.pop()
    return rows


def read_by_spark(spark, path, separator=","):
    rows = sorted(delimited_grid(spark, str(path), separator).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    assert all(r["width"] == len(r["cells"]) for r in rows)
    return [r["cells"] for r in rows]


@pytest.mark.parametrize("separator", [",", ";", "|", "\t"])
def test_quoted_line_breaks_over_many_splits(spark, small_splits, tmp_path, separator):
    """Records over lines and splits, doubled quotes, and quotes within plain cells, as Python's csv reads them."""
    rng = random.Random(separator)
    parts = ["a", "b c", '""', "\n", separator, "\n\n", "é", "'", "\r\n", "x" * 30]
    records = []
    for _ in range(2500):
        cells = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                cells.append('"' + "".join(rng.choices(parts, k=rng.randint(0, 6))) + '"')
            elif kind < 0.5:
                cells.append(rng.choice(['5" pipe', 'say "x"', '"a"tail', '"a"b"c', 'x"']))
            else:
                cells.append(rng.choice(["", "plain", " spaced ", "1.5"]))
        records.append(separator.join(cells))
    path = tmp_path / "many.csv"
    path.write_bytes(("\n".join(records) + "\n").encode())
    expected = read_plainly(path, separator)
    assert path.stat().st_size > 20 * 2000 and len(expected) < 2501
    assert read_by_spark(spark, path, separator) == expected


def test_a_record_over_many_splits(spark, small_splits, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text('a,b\n1,"' + "line of a long cell\n" * 2000 + '"\nc,d\n')
    assert read_by_spark(spark, path) == read_plainly(path)


def test_a_cell_of_doubled_quotes(spark, tmp_path):
    path = tmp_path / "quotes.csv"
    path.write_text('k,"' + '""' * 100_000 + '",end\n"' + '""' * 50_000 + "\n" + '""x' * 50_000 + '"\n')
    assert read_by_spark(spark, path) == read_plainly(path)


def test_line_ends_of_two_characters(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes(b'a,b\r\n\r\n1,"x\r\ny"\r\n2,z')
    assert read_by_spark(spark, path) == read_plainly(path) == [["a", "b"], [], ["1", "x\r\ny"], ["2", "z"]]


def test_separators(spark):
    for wrong in ("", '"', "\n", "ab"):
        with pytest.raises(ValueError, match="cannot separate"):
            delimited_grid(spark, "nowhere", wrong)


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x\ny,q,r\n')
    with pytest.raises(Exception, match="quote is left open"):
        delimited_grid(spark, str(tmp_path / "q.csv")).collect()
