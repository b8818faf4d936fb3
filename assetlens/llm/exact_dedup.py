"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.llm import frames

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """What is compared: the whole text with A-Z in lower case, a missing one as empty."""
    return frames.ascii_lower(frames.whole(text))


def marks(text: Column) -> list[Column]:
    """Length and prefix hash. Lower-casing A-Z keeps the length, so only the prefix is normalised."""
    return [
        F.octet_length(frames.whole(text)).alias("n_bytes"),
        F.xxhash64(normalised(F.substring(text, 1, PREFIX_CHARS))).alias("prefix_hash"),
    ]


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] = ()
) -> DataFrame:
    """One row per row of `docs`: its id, the columns `carry`, `keep_id`, `group_size`, `kept`.

    Of texts that are equal but for the case of A-Z, the row with the largest id stays.

    1. One scan counts rows by length and prefix hash; pairs that occur once are done.
    2. A second scan hashes the whole text of the rows whose pair occurs more often. A bitmap of
       fixed size tells which these may be; a row it lets pass needlessly is merely hashed.
    3. Rows are grouped by length, prefix hash and full hash. Texts are never shuffled.

    Missing and empty texts are equal. A missing id is smaller than any other; a group without
    ids keeps one row, with a missing `keep_id`. Of rows that share the largest id one is kept.
    An empty table gives an empty one. Columns of `docs` that aren't asked for play no part.
    """
    text = F.col(text_col)
    suspects = (
        docs.select(*marks(text))
        .groupBy("n_bytes", "prefix_hash")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("n_bytes", "prefix_hash")
    )
    read = docs.select(
        F.struct(F.col(id_col).alias(id_col), *carry).alias("row"),
        text.alias("text"),
        *marks(text),
    )
    read = frames.with_possible(read, frames.slot_bitmaps(suspects), "n_bytes", "prefix_hash")
    digest = F.when(F.col("possible"), F.unhex(F.sha2(normalised(F.col("text")), 256)))
    rows = frames.staged(
        frames.numbered(read.select("row", "n_bytes", "prefix_hash", digest.alias("full_hash"))),
        "exact-rows",
    )
    keys = ["n_bytes", "prefix_hash", "full_hash"]
    groups = (
        rows.filter("full_hash IS NOT NULL")
        .groupBy(*keys)
        .agg(
            F.max(F.struct(F.col(f"row.{id_col}").alias("id"), "marker")).alias("best"),
            F.count("*").alias("group_size"),
        )
        .filter("group_size > 1")
    )
    alone = F.col("best").isNull()
    return rows.join(frames.staged(groups, "exact-groups"), keys, "left").select(
        "row.*",
        F.when(alone, F.col(f"row.{id_col}")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.marker") == F.col("marker"))).alias("kept"),
    )
