"""Tables written on the way."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from assetlens.llm import frames


def test_small_batches(spark, tmp_path, monkeypatch):
    """Python gets rows in batches of a few MB while a table is written; the session's own limit is as before."""
    monkeypatch.setattr(frames, "shared_folder", lambda spark: str(tmp_path))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    rows = frames.staged(texts.mapInArrow(sizes, "n bigint, size bigint"), "sizes").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) < 6 << 20
    assert spark.conf.get(key) == before


def test_rows_of_stored_tables_are_not_written_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "given")
    for n in (30, 20):
        spark.range(n).select((F.col("id") % 3).alias("k"), F.lit("t").alias("a.`b")).repartition(2).write.mode("append").parquet(path)
    monkeypatch.setattr(frames, "shared_folder", lambda spark: str(tmp_path / "shared"))
    docs = spark.read.parquet(path)
    rows = frames.as_rows(docs, "rows")
    got = rows.select("marker", "row.*").collect()
    assert len({r.marker for r in got}) == 50 and rows.select("row.*").columns == docs.columns
    assert sorted(r.k for r in got) == sorted(r[0] for r in docs.collect())
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.select("marker", "row.*").collect()))
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()} == {"rows-files"}


def test_rows_of_all_else_are_written(spark, tmp_path):
    """A number per row also where a file's rows come twice, or not all."""
    spark.range(10).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    twice = docs.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    for other in (twice, docs.crossJoin(spark.range(2).toDF("k")), docs.filter("id > 3"), docs.union(docs), spark.range(4)):
        assert not frames.is_stored(other)
        rows = frames.as_rows(other, "rows")
        assert rows.select("marker").distinct().count() == rows.count() == other.count()
    assert frames.is_stored(docs) and frames.is_stored(frames.staged(docs, "t"))
