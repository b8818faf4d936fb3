"""Inputs for the registered queries, all derived by Spark from the given tables.

Everything grows with the tables: one asset per line item, one extract per 32 orders, one
workbook per customer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.checks.packing import pack_workbook
from assetlens.plans.register import Register
from assetlens.session import new_path
from assetlens.sources.listing import store_of

AS_OF = "2001-06-15 10:30:00"
ORDERS_PER_EXTRACT = 32

# Header rows by style; an extract's style is its number modulo their count.
HEADER_STYLES: list[list[str]] = [
    ["Asset Tag", "Model", "User"],
    ["Asset Tag", "Product", "User Email"],
    ["User Email", "USER", "asset_tag", "Asset Tag", "Model", "Place"],
    ["Product Type", "Product", "Programme", "Asset-Tag"],
    ["Model No", "Product", "Department"],
    ["Asset Tag", "Serial Number", "User", "Department"],
    [" Asset Tag ", "Model", "Model", "Asset Tag", "User ", "", "Website"],
    [
        "Asset Tag",
        "Model",
        "Workstation Type",
        "Serial Number",
        "User",
        "User Email",
        "Department",
        "Location",
        "Site",
        "Year Of Purchase",
        "Warranty Expiry",
        "Place",
        "Workstation Status",
        "State",
    ],
]
WORKBOOK_HEADERS = ["Asset Tag", "Model", "User", "Warranty Expiry"]


# Columns used, with their types: with a given schema no footer is read before the query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by `key` over as many tasks as shuffles have, also where it is small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Where inputs were written, by application, folder of tables and name.
_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> DataFrame:
    """`rows` as a stored table, which the first query of a session that needs it writes.

    So a query's time is that of its operators over a table, as a user has one, not of making the input.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    jvm = spark._jvm.org.apache.hadoop.fs
    path = _stored.get(key)
    done = path and jvm.Path(path, "_SUCCESS")
    if not done or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        path = _stored[key] = new_path(spark, name)
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their parts, orders, customers and places; of times only the days.

    Orders meet their customers and line items their parts before both meet. So a line item is shuffled at
    most twice, and without the columns of its order, which are shuffled once an order.
    """
    bought = (
        table(spark, sf_dir, "orders")
        .withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    )


def _tag(prefix: str) -> Column:
    tag = F.concat(F.lit(prefix), _text("l_orderkey"), F.lit("-"), _text("l_linenumber"))
    return F.when(F.col("l_orderkey") % 97 != 0, tag)


def _serial(prefix: str) -> Column:
    return F.concat(F.lit(prefix), _text("l_partkey"), F.lit("-"), _text("l_suppkey"))


def _user() -> Column:
    key = F.col("o_custkey")
    return F.when(key % 23 == 0, None).when(key % 29 == 0, "").otherwise(F.col("c_name"))


def _email() -> Column:
    key = F.col("o_custkey")
    user = F.concat(F.lit("user"), _text("o_custkey"))
    return (
        F.when(key % 13 == 0, None)
        .when(key % 11 == 0, F.concat(user, F.lit(".example.com")))
        .when(key % 7 == 0, F.concat(user, F.lit("@example.com (old)")))
        .otherwise(F.concat(user, F.lit("@example.com")))
    )


def _year() -> Column:
    key = F.col("o_orderkey")
    return (
        F.when(key % 31 == 0, "n/a")
        .when(key % 37 == 0, None)
        .otherwise(F.year("o_orderdate").cast("string"))
    )


def _warranty() -> Column:
    key = F.col("l_orderkey")
    expiry = F.add_months("l_shipdate", 36).cast("string")
    return F.when(key % 41 == 0, "unknown").when(key % 43 == 0, None).otherwise(expiry)


def _region() -> Column:
    return F.when(F.col("n_nationkey") % 9 != 0, F.col("r_name"))


def workstation_register(spark: SparkSession, sf_dir: str) -> Register:
    """One workstation per line item, with repeated tags, gaps and dirt."""
    segment = F.when(F.col("o_custkey") % 47 != 0, F.col("c_mktsegment"))
    return Register.of(
        stored(
            spark,
            sf_dir,
            "workstations",
            _joined(spark, sf_dir).select(
                _tag("AT").alias("Asset Tag"),
                F.col("p_brand").alias("Model"),
                F.col("p_type").alias("Workstation Type"),
                _serial("SN").alias("Serial Number"),
                _user().alias("User"),
                _email().alias("User Email"),
                segment.alias("Department"),
                F.col("n_name").alias("Location"),
                F.col("o_orderpriority").alias("Site"),
                _year().alias("Year Of Purchase"),
                _warranty().alias("Warranty Expiry"),
                _region().alias("Place"),
                F.col("l_linestatus").alias("Workstation Status"),
                F.col("o_orderstatus").alias("State"),
            ),
        )
    )


def mobile_register(spark: SparkSession, sf_dir: str) -> Register:
    """One mobile per line item; without addresses and warranty."""
    return Register.of(
        stored(
            spark,
            sf_dir,
            "mobiles",
            _joined(spark, sf_dir).select(
                _tag("MB").alias("Asset Tag"),
                F.col("p_name").alias("Product"),
                F.col("p_type").alias("Product Type"),
                _serial("SNM").alias("Serial Number"),
                _user().alias("User"),
                F.col("c_mktsegment").alias("Department"),
                F.col("n_name").alias("Location"),
                _region().alias("Site"),
                _year().alias("Year Of Purchase"),
                F.col("o_orderpriority").alias("Programme"),
                F.col("o_orderstatus").alias("State"),
            ),
        )
    )


# ------------------------------------------------------------------------- grids


def _extract(key: Column) -> Column:
    return F.floor(key / ORDERS_PER_EXTRACT).cast("bigint")


def _header_position(extract: Column) -> Column:
    return F.when(extract % 17 == 0, -1).otherwise(extract % 5).cast("bigint")


def _path(extract: Column) -> Column:
    return F.concat(F.lit("extract_"), extract.cast("string"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of 32 orders each: titles, a header row (not in every 17th), data rows.

    Data cells say which order and column they come from; some are blank or marked missing.
    """
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    style = F.col("k") % len(HEADER_STYLES)
    headers = F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in HEADER_STYLES])
    placed = orders.withColumn("k", _extract(F.col("o_orderkey"))).withColumn(
        "hp", _header_position(F.col("k"))
    )
    width = F.size(F.get(headers, style.cast("int")))
    data_cells = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda c: F.when((F.col("o_orderkey") + c) % 11 == 0, "")
        .when((F.col("o_orderkey") + c) % 13 == 0, "N/A")
        .otherwise(F.concat(F.lit("v"), _text("o_orderkey"), F.lit("_"), c.cast("string"))),
    )
    body = placed.select(
        _path(F.col("k")).alias("path"),
        (F.col("hp") + 1 + F.col("o_orderkey") % ORDERS_PER_EXTRACT).alias("pos"),
        data_cells.alias("cells"),
    )
    extracts = placed.select("k", "hp").distinct()
    top = extracts.where(F.col("hp") >= 0).select(
        _path(F.col("k")).alias("path"),
        F.posexplode(
            F.concat(
                F.array_repeat(F.array(F.lit("Register printout")), F.col("hp").cast("int")),
                F.array(F.get(headers, style.cast("int"))),
            )
        ).alias("pos", "cells"),
    )
    rows = body.unionByName(top.withColumn("pos", F.col("pos").cast("bigint")))
    rows = rows.select("path", F.lit("Assets").alias("sheet"), "pos", F.size("cells").alias("width"), "cells")
    return stored(spark, sf_dir, "grid", rows)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual header row per extract: for most none, for some one out of range."""
    k = _extract(F.col("o_orderkey"))
    return (
        table(spark, sf_dir, "orders")
        .select(k.alias("k"))
        .distinct()
        .select(
            _path(F.col("k")).alias("path"),
            F.lit("Assets").alias("sheet"),
            F.when(F.col("k") % 10 == 0, F.col("k") % 27).alias("header_row"),
        )
    )


#: Date patterns that registers write their dates in; a register's is its number modulo their count.
DATE_STYLES = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd MMM yyyy", "dd.MM.yyyy"]
DATED_REGISTERS = 200


def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date as text per order, in a register of its customer: each register in its own style, with dirt."""
    number = F.col("o_custkey") % DATED_REGISTERS
    key = F.col("o_orderkey")
    styled = F.coalesce(
        *[
            F.when(number % len(DATE_STYLES) == i, F.date_format("o_orderdate", pattern))
            for i, pattern in enumerate(DATE_STYLES)
        ]
    )
    value = (
        F.when(key % 19 == 0, None)
        .when(key % 23 == 0, "unknown")
        .when(key % 29 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(styled)
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("register_"), number.cast("string")).alias("path"),
        F.lit("Assets").alias("sheet"),
        key.alias("pos"),
        value.alias("value"),
    )


def printouts(spark: SparkSession, sf_dir: str) -> str:
    """A folder of delimited text: a record per customer, with quotes and line ends within cells."""
    key = F.col("c_custkey")
    note = F.when(key % 4 == 0, F.concat(F.lit('said ""'), "c_mktsegment", F.lit('""\n\nand, left'))).when(
        key % 4 == 1, F.concat("c_mktsegment", F.lit("\n"))
    )
    cells = [
        _text("c_custkey"),
        F.when(note.isNotNull(), F.concat(F.lit('"'), note, F.lit('"'))).otherwise(F.col("c_mktsegment")),
        F.when(key % 5 != 0, F.col("c_name")).otherwise(""),
        F.when(key % 3 == 0, F.lit('6" rack')).otherwise(""),
    ]
    folder = new_path(spark, "printouts")
    table(spark, sf_dir, "customer").select(F.concat_ws(",", *cells).alias("value")).write.text(folder)
    return folder


# --------------------------------------------------------------------- workbooks


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            key = row.c_custkey
            sheets = {
                "Assets": [
                    ["Asset register"],
                    [],
                    WORKBOOK_HEADERS,
                    [f"AT{key}", row.c_mktsegment, row.c_name, int(36526 + key % 1000)],
                ]
            }
            if key % 3 == 0:
                sheets["Notes"] = [[None, int(key), row.c_nationkey % 2 == 0]]
            content = pack_workbook(sheets, shared=key % 2 == 0, date_columns={3})
            out.append((f"wb_{key}.xlsx", b"not a workbook" if key % 10 == 9 else content))
        paths, contents = zip(*out, strict=True) if out else ((), ())
        yield pd.DataFrame({"path": paths, "content": contents})


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small workbook per customer; every tenth file is not a workbook."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey"
    )
    files = spread(rows, "c_custkey").mapInPandas(_pack, "path string, content binary")
    return stored(spark, sf_dir, "workbooks", files.withColumn("length", F.length("content").cast("bigint")))


UPLOAD_FOLDERS = 16


def upload_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file per customer in one of 16 folders: workbooks, other files, and empty ones."""
    folder = new_path(spark, "uploads")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place, _ = store_of(folder)
        for batch in batches:
            for number, name, content in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                below = f"{place}/f{number}"
                store.create_dir(below, recursive=True)
                with store.open_output_stream(f"{below}/{name}") as file:
                    file.write(content)
            yield batch.select([0])

    key = F.regexp_extract("path", r"\d+", 0).cast("int")
    content = F.when(key % 25 == 0, F.lit(b"")).otherwise(F.col("content"))
    files = workbooks(spark, sf_dir).select((key % UPLOAD_FOLDERS).alias("number"), "path", content.alias("content"))
    files.mapInArrow(write, "number int").write.format("noop").mode("overwrite").save()
    return folder
