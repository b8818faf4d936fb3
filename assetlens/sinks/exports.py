"""Exports of a register as distributed datasets, one folder each."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetlens.operators.roles import WORKSTATION
from assetlens.plans.register import Register

ALL, REPLACEMENT, WARRANTY = "all", "replacement", "warranty"


def export_name(kind: str, segment: str, as_of: datetime) -> str:
    """Folder name of an export: segment and day, and the kind of register where it matters."""
    day = as_of.strftime("%Y%m%d")
    if segment == WARRANTY:
        return f"warranty_expired_{day}"
    return f"{kind.lower()}_{'assets' if segment == ALL else 'expired'}_{day}"


def with_typed_headers(register: Register) -> DataFrame:
    """The rows under the headers as typed.

    Headers that differ in case only cannot be stored side by side in a table; such a register
    keeps its column names.
    """
    headers = list(register.headers.values())
    clash = len({h.lower() for h in headers}) < len(headers)
    return register.df if clash else register.df.toDF(*headers)


def write_export(
    register: Register, folder: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write all rows and columns; every task writes its own part."""
    writer = with_typed_headers(register).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(folder)


def segments_of(
    shown: Register, replacement: Register | None, expired: Register | None
) -> list[tuple[str, Register]]:
    """What is exported: all shown rows always, the others if they have rows."""
    segments: list[tuple[str, Register]] = [(ALL, shown)]
    if replacement is not None and not replacement.df.isEmpty():
        segments.append((REPLACEMENT, replacement))
    if shown.kind == WORKSTATION and expired is not None and not expired.df.isEmpty():
        segments.append((WARRANTY, expired))
    return segments


def write_exports(
    base: str,
    shown: Register,
    replacement: Register | None,
    expired: Register | None,
    as_of: datetime,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Write the exports that have rows; the full one is written always.

    `expired` are the warranty-expired rows of the unfiltered register; only workstation
    registers have that export. Returns the folder per segment.
    """
    folders = {}
    for segment, register in segments_of(shown, replacement, expired):
        folder = f"{base.rstrip('/')}/{export_name(shown.kind, segment, as_of)}"
        write_export(register, folder, fmt, mode)
        folders[segment] = folder
    return folders


#: Not a part of the data to readers, as its name begins with an underscore.
MANIFEST = "_manifest.json"
#: So that cells of text come back as they are: with quotes, line ends and white space.
OPTIONS = {
    "csv": {
        "header": "true",
        "escape": '"',
        "multiLine": "true",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
}


def content_digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of them that does not depend on their order or parts."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in rows.columns]
    total = F.coalesce(F.sum(F.xxhash64(*text).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    found = rows.agg(F.count("*").alias("n"), total.cast("string").alias("digest")).first()
    return found["n"], found["digest"]


def commit_export(register: Register, folder: str, fmt: str = "parquet") -> dict:
    """Write an export so that `folder` has either all of it with a manifest or does not exist.

    Parts are written to a folder beside it, read back, and counted and hashed against the rows given;
    then the manifest is written and the folder gets its name, in one step of the file system. A task that
    runs twice leaves one part, by Spark's commit of the write; a job that fails leaves nothing under the
    name. A folder that is there already is an error, whoever made it.
    """
    rows = with_typed_headers(register)
    if fmt == "csv":
        # Delimited text doesn't tell empty cells from missing ones.
        rows = rows.select([F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])
    spark = rows.sparkSession
    options = OPTIONS.get(fmt, {})
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    final, staging = hadoop(folder), hadoop(f"{folder}.{uuid.uuid4().hex}.partial")
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(final):
        raise FileExistsError(folder)
    try:
        rows.write.format(fmt).options(**options).save(staging.toString())
        back = spark.read.schema(rows.schema).options(**options).format(fmt).load(staging.toString())
        found = content_digest(back)
        if found != content_digest(rows):
            raise RuntimeError(f"{folder}: what was written differs from the rows")
        manifest = {"rows": found[0], "digest": found[1], "format": fmt, "schema": rows.schema.jsonValue()}
        out = system.create(hadoop(staging, MANIFEST))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if system.exists(final) or not system.rename(staging, final):
            raise FileExistsError(folder)
    finally:
        if system.exists(staging):
            system.delete(staging, True)
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """What a committed export says about itself; an error where nothing was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(f"{folder} is no committed export")
    stream = system.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a committed export, in the schema that its manifest names."""
    manifest = read_manifest(spark, folder)
    schema = StructType.fromJson(manifest["schema"])
    options = OPTIONS.get(manifest["format"], {})
    return spark.read.schema(schema).options(**options).format(manifest["format"]).load(folder)


def commit_exports(
    base: str,
    shown: Register,
    replacement: Register | None,
    expired: Register | None,
    as_of: datetime,
    fmt: str = "parquet",
) -> dict[str, str]:
    """`commit_export` of the exports that have rows, under their names; the folder per segment."""
    folders = {}
    for segment, register in segments_of(shown, replacement, expired):
        folders[segment] = f"{base.rstrip('/')}/{export_name(shown.kind, segment, as_of)}"
        commit_export(register, folders[segment], fmt)
    return folders
