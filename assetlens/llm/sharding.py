"""Shards that all have the mixture of the whole, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.llm import frames

SHARDS = 24
SEED = 23


def placed(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`rows` (marker, id, source_key and others; a written table) with `shard` and `slot`.

    Rows of a source are shuffled by a seeded hash of their id and ranked; rank k of n has the
    fraction (k - 1/2) / n. All rows in the order of their fraction are cut into shards whose
    counts differ by one at most. A stretch of the order that holds a share of all fractions holds
    that share of every source, up to a row.
    """
    drawn = rows.withColumn(
        "draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    )
    in_source = frames.ranked(drawn, ["source_key"], ["draw", "id"])
    sizes = frames.staged(
        rows.groupBy("source_key").agg(F.count("*").alias("source_rows")), "shard-sources"
    )
    fraction = (F.col("rank") - 0.5) / F.col("source_rows")
    spread = in_source.join(sizes, "source_key").select(
        *rows.columns, "draw", fraction.alias("fraction"), F.lit(0).alias("all")
    )
    in_order = frames.ranked(
        frames.staged(spread, "shard-spread"), ["all"], ["fraction", "source_key", "draw"]
    )
    total = F.lit(rows.count())
    at = F.col("rank") - 1
    shard = F.floor(at * shards / total)
    first = F.ceil(shard * total / shards)
    return in_order.select(
        *rows.columns, shard.cast("int").alias("shard"), (at - first).cast("bigint").alias("slot")
    )


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's bytes in UTF-8 plus 8 (a missing text has none), text_crc32 that of the
    bytes, unsigned, 0 for missing and empty texts. The law is `rows`: counts of shards differ by
    one at most, slots run from 0 without gaps, and grown_shard, which belongs to another law, is
    null. A missing source is a source. Rows with the same id are shuffled as one draw and told
    apart by their number. Fewer rows than shards leave shards empty; an empty table gives an
    empty one; further columns play no part.
    """
    text = F.col(text_col)
    rows = frames.staged(
        frames.numbered(
            docs.select(
                F.col(id_col).alias("id"),
                (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
                F.crc32(frames.whole(text).cast("binary")).alias("text_crc32"),
                source_key(F.col(source_col)).alias("source_key"),
            )
        ),
        "shard-rows",
    )
    return placed(rows, shards).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """The rows of `docs` with `shard` and `slot`, by the same rules as `shard_rows`.

    Columns of `docs` with these two names give way. Texts move once, to meet their place; a stored table
    isn't written again (`frames.as_rows`).
    """
    rows = frames.as_rows(docs, "shard-docs")
    narrow = rows.select(
        "marker",
        F.col(f"row.`{id_col}`").alias("id"),
        source_key(F.col(f"row.`{source_col}`")).alias("source_key"),
    )
    places = placed(frames.staged(narrow, "shard-rows"), shards).select("marker", "shard", "slot")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(frames.staged(places, "shard-places"), "marker").select(
        *[F.col(f"row.`{c}`").alias(c) for c in own], "shard", "slot"
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
