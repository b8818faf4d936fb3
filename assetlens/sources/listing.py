"""Files of a large store, listed by folders in tasks, with their length and first bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES = 4
ROWS_PER_BATCH = 4096
FILES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary())])


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, place within it, and what a place's address begins with, as Spark writes it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    store, place = fs.FileSystem.from_uri(path)
    scheme, _, rest = path.partition("://")
    authority = rest.removesuffix(place) if place.startswith("/") else ""
    return store, place, f"{scheme}://{authority}"


class Folder(InputPartition):
    """What one task lists: a folder with all below it, or only the files right in it."""

    def __init__(self, place: str, recursive: bool) -> None:
        self.place, self.recursive = place, recursive


class FolderReader(DataSourceReader):
    """Plans a task per folder of the first `levels` levels, and lists and opens files in the tasks.

    The driver sees folders of these levels only, never files. A folder that holds all files itself is one task.
    """

    def __init__(self, path: str, levels: int) -> None:
        self.path, self.levels = path, levels

    def partitions(self) -> list[InputPartition]:
        store, place, _ = store_of(self.path)
        found, open_folders = [], [place.rstrip("/") or "/"]
        for _ in range(self.levels):
            below = []
            for folder in open_folders:
                found.append(Folder(folder, False))
                entries = store.get_file_info(fs.FileSelector(folder))
                below += [entry.path for entry in entries if entry.type == fs.FileType.Directory]
            open_folders = below
        return found + [Folder(folder, True) for folder in open_folders]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _, prefix = store_of(self.path)
        rows: list[tuple] = []
        for entry in store.get_file_info(fs.FileSelector(partition.place, recursive=partition.recursive)):
            if entry.type != fs.FileType.File:
                continue
            head = b""
            if entry.size:
                with store.open_input_stream(entry.path, compression=None) as file:
                    head = file.read(HEAD_BYTES)
            rows.append((prefix + entry.path, entry.size, head))
            if len(rows) == ROWS_PER_BATCH:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FILES, strict=True)], schema=FILES)


class FileHeads(DataSource):
    """`path, length, head` of all files under a folder, empty ones too."""

    @classmethod
    def name(cls) -> str:
        return "assetlens_files"

    def schema(self) -> str:
        return "path string, length bigint, head binary"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("levels", "1")))


def listed_files(spark: SparkSession, path: str, levels: int = 1) -> DataFrame:
    """All files under `path` as `path, length, head` (their first bytes), those without content too.

    Tasks list a folder each, of the first `levels` levels of folders, and read a few bytes of each file; so
    neither the list of files nor their content passes through the driver, and a store is judged without
    reading it. The store has to be one that Arrow opens (local, s3, gs, hdfs and the like).
    """
    spark.dataSource.register(FileHeads)
    return spark.read.format(FileHeads.name()).option("levels", str(levels)).load(path)
