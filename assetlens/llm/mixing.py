"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm import frames

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17


def unit(key: Column) -> Column:
    """A number from 0 up to 1 that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / (2**32)


def targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """`sizes` (source_key, source_size) with `target`.

    Sources in the order of their keys weigh `weights`, repeating, and share `share` of all words
    by weight. No target is above `most` times its source's size; the excess is shared again by
    weight. That ends where the sources with the least room for their weight are full and the
    others have one amount per unit of weight, so one pass in the order of room finds it.
    The windows run over one row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_key = Window.orderBy("source_key")
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "source_key")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"),
    )
    weighed = sizes.withColumn("weight", weight).withColumn("room", F.col("source_size") * most)
    rest = F.sum("source_size").over(everything) * share - F.coalesce(
        F.sum("room").over(earlier), F.lit(0.0)
    )
    per_weight = rest / F.sum("weight").over(
        by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    filled = weighed.withColumn("per_weight", per_weight).withColumn(
        "full", (F.col("room") <= F.col("per_weight") * F.col("weight")).cast("int")
    )
    filled = filled.withColumn(
        "full", F.min("full").over(by_room.rowsBetween(Window.unboundedPreceding, 0))
    )
    level = F.min(F.when(F.col("full") == 0, F.struct("room_rank", "per_weight"))).over(everything)
    filled = filled.withColumn("room_rank", F.row_number().over(by_room)).withColumn("level", level)
    target = F.when(F.col("full") == 1, F.col("room").cast("double")).otherwise(
        F.col("level.per_weight") * F.col("weight")
    )
    return filled.select("source_key", "source_size", target.alias("target"))


def decisions(rows: DataFrame, seed: int = SEED, **rule) -> DataFrame:
    """`rows` (marker, id, size, source_key; a written table) with source_size, target and copies.

    Within a source, documents stand in the order of size, then of a hash of their id. Each
    expects target / source_size copies; a document gets one copy per integer that the running
    sum of these, plus one random offset, passes at it. With the order by size, the words taken
    differ from the target by no more than a few documents' words.
    """
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, **rule).withColumn(
        "offset", unit(F.concat(F.lit(f"{seed}:"), F.col("source_key")))
    )
    drawn = rows.withColumn("draw", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    in_order = frames.ranked(drawn, ["source_key"], ["size", "draw", "id"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def passed(position: Column) -> Column:
        return F.floor(position * rate + F.col("offset"))

    copies = passed(F.col("rank")) - passed(F.col("rank") - 1)
    return in_order.join(frames.staged(plan, "mix-plan"), "source_key").withColumn("copies", copies)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """marker, id, size and source_key of each row; a missing source comes last."""
    source = F.col(source_col)
    return frames.staged(
        frames.numbered(
            docs.select(
                F.col(id_col).alias("id"),
                frames.word_count(F.col(text_col)).alias("size"),
                F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
            )
        ),
        "mix-rows",
    )


def mix_sizes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **rule,
) -> DataFrame:
    """Per row of `docs`: its id, size, source_size, target, taken (words taken, repeats counted).

    Size is the number of words. Missing and empty texts have size 0 and stay out of the sums,
    not out of the result; a source without words has target 0. Rows that share id, source and
    size are alike to the mix: which of them is taken is left open. Reruns give the same rows.
    An empty table gives an empty one; further columns play no part.
    """
    rows = measured(docs, id_col, text_col, source_col)
    return decisions(rows, **rule).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **rule,
) -> DataFrame:
    """The mixed rows, with the columns of `docs`: each row as often as the mix takes it.

    The same rules as `mix_sizes`. Rows have a number (`frames.as_rows`), are decided on without
    their texts, and joined with their number of copies. Their columns travel in one struct,
    so no name of theirs can clash.
    """
    rows = frames.as_rows(docs, "mix-docs")
    source = F.col(f"row.`{source_col}`")
    narrow = rows.select(
        "marker",
        F.col(f"row.`{id_col}`").alias("id"),
        frames.word_count(F.col(f"row.`{text_col}`")).alias("size"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
    )
    taken = decisions(frames.staged(narrow, "mix-rows"), **rule).filter("copies > 0")
    return (
        rows.join(frames.staged(taken.select("marker", "copies"), "mix-taken"), "marker")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("row.*")
    )
