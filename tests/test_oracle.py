"""Every registered query against SQL over the same tables."""

import pytest

import __spark_entry__ as entry
from assetlens.checks.oracle import all_sql
from assetlens.checks.queries import all_queries
from compare import duck, spark_rows, sql_rows, type_differences

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(medium):
    return duck(medium)


def test_every_query_of_the_core_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(all_sql()))
def test_query(spark, medium, connection, name):
    df = QUERIES[name](spark, medium)
    expected = sql_rows(connection, SQL[name])
    assert spark_rows(df) == expected
    assert not type_differences(df, connection, SQL[name])
    assert expected[1], "a query without rows shows nothing"


def test_entry(spark):
    rows = {r["warranty_status"]: r["n"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"Expired", "Expiring Soon", "Active", "Unknown"}
    assert sum(rows.values()) == 6000


def test_known_counts(spark, medium):
    def pairs(name):
        return {r[0]: r[1] for r in QUERIES[name](spark, medium).collect()}

    assert pairs("warranty_counts") == {
        "Expired": 29032, "Expiring Soon": 2164, "Active": 25951, "Unknown": 2853,
    }
    assert list(pairs("age_counts").values()) == [17119, 17092, 17127, 8662]
    report = {r["issue"]: r["n"] for r in QUERIES["quality_report"](spark, medium).collect()}
    assert list(report.values()) == [11665, 7500, 4902, 5072]
    kpis = QUERIES["summary_kpis"](spark, medium).first()
    assert kpis[:3] == (394, -628, 1022)
    assert round(kpis["replacement_rate"], 2) == 259.39
