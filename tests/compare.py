"""Comparison of Spark and SQL results, regardless of row order."""

from __future__ import annotations

import datetime
import math

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(value(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return rows_by_name(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql):
    result = connection.execute(sql)
    return rows_by_name([d[0] for d in result.description], result.fetchall())


# Types that both engines call differently; anything else has to agree.
TYPE_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, connection, sql):
    described = {r[0]: r[1] for r in connection.execute(f"describe {sql}").fetchall()}
    return {
        name: (kind, described.get(name))
        for name, kind in df.dtypes
        if TYPE_NAMES.get(kind, kind) != described.get(name)
    }
