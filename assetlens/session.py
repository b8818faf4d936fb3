"""Session defaults, and the folder in which lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions that keep one shuffle partition near 128 MB, and every core busy."""
    return max(cores, -(-input_bytes // TARGET_PARTITION_BYTES))


def build_session(
    app: str = "assetlens",
    master: str | None = None,
    partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster give `partitions` from `shuffle_partitions`; adaptive execution merges
    the ones that turn out small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names.

    A local session that names none gets a folder of its own. On a cluster a machine-local folder would
    not do, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="assetlens-")
        folder = _own_folders[context.applicationId]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "assetlens") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write `df` as a table under the shared checkpoint folder and read it from there.

    Used where two branches of a plan have to see the very same rows, or where rows are costly
    to compute. The table outlives lost executors, and scans of it read only what they need.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
