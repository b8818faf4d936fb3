"""Session helpers."""

import pytest

from assetlens import session


def test_partitions():
    assert session.shuffle_partitions(0, 8) == 8
    assert session.shuffle_partitions(100 * 2**40, 4000) == 819_200


def test_staged_tables_are_read_back(spark):
    df = spark.range(10).selectExpr("id", "array(cast(id as string)) as cells")
    table = session.staged(df)
    assert table.dtypes == df.dtypes
    assert sorted(table.collect()) == sorted(df.collect())
    assert "FileScan" in table._jdf.queryExecution().executedPlan().toString()


class Unnamed:
    """A session that names no folder."""

    class conf:
        @staticmethod
        def get(_, default):
            return default

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_without_a_folder():
    own = session.checkpoint_folder(Unnamed("local[2]"))
    assert own == session.checkpoint_folder(Unnamed("local[2]"))
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_folder(Unnamed(master))
