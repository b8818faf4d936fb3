"""What the operators share: written tables, text expressions, bounded filters and distributed ranks."""

from __future__ import annotations

import gc
import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.session import checkpoint_folder

SLOT_BITS = 26
#: A file has fewer rows than two to this power.
FILE_ROW_BITS = 40
#: Spark gives Python about so many bytes at a time while it writes or counts; whole rows, however long.
ARROW_BATCH = "4m"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; in a local session without one, a new folder."""
    return checkpoint_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ARROW_BATCH for the jobs started meanwhile.

    Spark's own 64 MB are held several times over by each task, in the JVM outside of its heap and in its Python
    worker, and both keep much of what they once had. All rows come, in more batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, ARROW_BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read from there.

    Cuts lineage, freezes row numbers given in `df`, and outlives lost executors.
    """
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `staged`, once nothing that is still to be computed reads them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of jobs that are over.

    They do so when the driver's JVM finds that nothing refers to them, which it may not look for in hours.
    """
    gc.collect()
    spark._jvm.System.gc()


def whole(text: Column) -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; a missing text has none."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def numbered(df: DataFrame) -> DataFrame:
    """`df` with `marker`, a number per row. Write it as a table before using it twice."""
    return df.withColumn("marker", F.monotonically_increasing_id())


def is_stored(docs: DataFrame) -> bool:
    """Whether `docs` is a table just as it is read from Parquet files: a folder of them, or some by name."""
    files = docs.inputFiles()
    folders = sorted({path.rsplit("/", 1)[0] for path in files})
    read = docs.sparkSession.read.schema(docs.schema)
    for paths in (folders, files) if files else ():
        # Spark tells paths with and without file:// apart.
        for own in (paths, [path.removeprefix("file://") for path in paths]):
            try:
                if docs.sameSemantics(read.parquet(*own)):
                    return True
            except AnalysisException:  # a name that can't be given back as it is told
                continue
    return False


def as_rows(docs: DataFrame, name: str) -> DataFrame:
    """`marker`, a number per row, and `row`, a struct of all columns: the same at each read.

    A row of a stored table has the number of its file, by path, and its place in there; nothing is
    written but the list of files. All other rows are numbered as they are written to a table.
    """
    if not is_stored(docs):
        return staged(numbered(docs.select(F.struct("*").alias("row"))), name)
    place = docs.metadataColumn("_metadata")
    read = docs.select(
        place["file_path"].alias("path"), place["row_index"].alias("at"), F.struct(*map(quoted, docs.columns)).alias("row")
    )
    files = read.select("path").distinct()
    files = staged(files.select("path", F.row_number().over(Window.orderBy("path")).alias("file")), f"{name}-files")
    number = F.shiftleft(F.col("file").cast("bigint"), FILE_ROW_BITS) + F.col("at")
    return read.join(F.broadcast(files), "path").select(number.alias("marker"), "row")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slot_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << SLOT_BITS)) + 1


def slot_bitmaps(keys: DataFrame) -> DataFrame:
    """A filter over all columns of `keys`, of 2^26 bits at most (2,048 rows of 4 KB), however many keys.

    It never misses a key. With many more than 10 million keys it lets most others pass too, so
    it may only spare work that is redundant, not decide.
    """
    slot = slot_of(*keys.columns)
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("slot_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("slot_bits")
    )


def with_possible(df: DataFrame, bitmaps: DataFrame, *keys: str) -> DataFrame:
    """`df` with `possible`: false only where the key isn't among those of the bitmaps.

    The broadcast is bounded by the filter's fixed size, 8 MB.
    """
    slot = slot_of(*keys)
    at = F.bitmap_bit_position(slot)
    joined = df.join(
        F.broadcast(bitmaps), F.bitmap_bucket_number(slot) == F.col("slot_bucket"), "left"
    )
    byte = F.conv(F.hex(F.substr("slot_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.getbit(byte.cast("bigint"), (at % 8).cast("int"))
    return joined.withColumn("possible", F.coalesce(bit == 1, F.lit(False))).drop(
        "slot_bucket", "slot_bits"
    )


def ranked(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """`rows` with `rank`, from 1, by `order` within each value of `within` (no nulls there).

    `rows` is a written table with a unique `marker`, which breaks ties. Rows are dealt out by
    ranges of the whole key, so that a value with a third of all rows takes a third of the
    tasks. Each task numbers its rows; what stands before them is a sum over one count per task
    and value.
    """
    key = [*within, *order, "marker"]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = staged(dealt.withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("task", F.shiftrightunsigned("at", 33))
    counts = placed.groupBy(*within, "task").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at")
    )
    before = Window.partitionBy(*within).orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *within,
        "task",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at") + 1).alias("shift"),
    )
    return placed.join(staged(offsets, "offsets"), [*within, "task"]).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("rank")
    )
