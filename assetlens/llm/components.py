"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm import frames


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the smallest of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = frames.staged(least.select("node", F.least("node", "least").alias("least")), "least")
    larger = both.filter(F.col("other") > F.col("node"))
    return larger.join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = frames.staged(down.groupBy("node").agg(F.min("other").alias("least")), "least")
    tied = down.join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return tied.union(own).filter("a != b").distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node of `edges` (a, b).

    Nodes see a minimum over their neighbours, never a list of them, so that a node with very many
    neighbours is no burden. The number of rounds grows with the logarithm of the longest chain.
    Every round is written to the shared folder.
    """
    edges = frames.staged(edges.filter("a != b").distinct(), "edges")
    before, now = None, state(edges)
    while now[0] and now != before:
        large = frames.staged(large_star(edges), "edges")
        frames.dropped(edges)
        edges = frames.staged(small_star(large), "edges")
        frames.dropped(large)
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
