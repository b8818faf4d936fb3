"""The registered queries that SQL can express, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from assetlens.llm.queries import llm_queries, llm_sql
from compare import duck, spark_rows, sql_rows, type_differences


def test_registered():
    assert set(llm_queries()) | {"pipeline"} <= set(entry.queries())
    assert set(llm_sql()) <= set(entry.oracle_sql())
    assert set(llm_sql()) <= set(llm_queries())


@pytest.mark.parametrize("name", list(llm_sql()))
def test_query(spark, medium, name):
    connection = duck(medium)
    df = llm_queries()[name](spark, medium)
    assert spark_rows(df) == sql_rows(connection, llm_sql()[name])
    assert not type_differences(df, connection, llm_sql()[name])
