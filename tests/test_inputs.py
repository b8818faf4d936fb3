"""The registers of the queries: whole over repeated and missing keys, and cheap to shuffle."""

import re
from collections import Counter
from datetime import datetime

import pytest

from assetlens.checks import derived as inputs

DAY = datetime(1999, 12, 31, 23, 59, 59)
ROWS = {
    "region": [(0, "EUROPE"), (1, None)],
    "nation": [(0, "N0", 0), (1, "N1", 1), (2, "N2", None), (1, "N1 again", 0)],
    "customer": [(1, "C1", 1, "S1"), (1, "C1 again", 0, None), (2, "C2", 2, "S2"), (None, "C", 0, "S"), (3, None, 0, "S3")],
    "part": [(1, "P1", "B1", "T1"), (1, "P1 again", "B1", None), (None, "P", "B", "T"), (2, "P2", None, "T2")],
    "orders": [(1, 1, "O", DAY, "LOW"), (1, 3, "F", None, None), (2, 2, "O", DAY, "LOW"), (None, 1, "O", DAY, "X"), (3, 3, "P", DAY, "Y")],
    "lineitem": [
        (1, 1, 7, 1, "O", DAY), (1, 1, 7, 1, "O", DAY), (1, 2, None, None, None, None), (2, 1, 7, 1, "F", DAY),
        (None, 1, 7, 1, "F", DAY), (3, None, 7, 1, "F", DAY), (3, 2, 8, 2, "F", DAY), (9, 2, 8, 2, "F", DAY),
    ],
}


@pytest.fixture
def odd_tables(spark, tmp_path):
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, inputs.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def matches(left, right, left_key, right_key):
    return [a + b for a in left for b in right if a[left_key] is not None and a[left_key] == b[right_key]]


def test_rows_are_whole(spark, odd_tables):
    rows = matches(ROWS["lineitem"], ROWS["orders"], 0, 0)
    rows = matches(rows, ROWS["part"], 1, 0)
    rows = matches(rows, ROWS["customer"], 7, 0)
    rows = matches(rows, ROWS["nation"], 17, 0)
    rows = matches(rows, ROWS["region"], 21, 0)
    expected = Counter((f"SNM{r[1]}-{r[2]}" if r[2] else None, r[12], r[16], r[20], r[8], r[9] and "1999") for r in rows)
    found = inputs.mobile_register(spark, odd_tables).df
    columns = ["serial_number", "product", "user", "location", "state", "year_of_purchase"]
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == expected and expected.total() > 10
    expiry = inputs.workstation_register(spark, odd_tables).df.select("warranty_expiry").distinct().collect()
    assert {r[0] for r in expiry} == {None, "2002-12-31"}


def test_line_items_are_shuffled_narrow(spark, odd_tables):
    """Without broadcasts, as on large tables: two shuffles, and none with columns of orders or customers."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = inputs._joined(spark, odd_tables)
        plan = joined._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffled = [set(re.findall(r"\w+(?=#)", m)) for m in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    line_items = [columns for columns in shuffled if "l_orderkey" in columns]
    assert len(line_items) == 2
    assert not any(c.startswith(("o_", "c_", "n_", "r_")) for columns in line_items for c in columns)
