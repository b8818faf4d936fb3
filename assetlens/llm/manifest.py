"""A Merkle tree over a dataset, by windows of fixed offsets; proofs and their check per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm import frames

#: Nodes that become one, and levels made in one pass. A block of 3 ** 7 rows is what one window sees.
FAN = 3
LEVELS = 7
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """H: the SHA-256 of the parts one after the other, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """H of the values, each `-` if missing, else its UTF-8 byte count, a colon and itself."""
    written = [value.cast("string") for value in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written])


def climbed(nodes: DataFrame) -> DataFrame:
    """`nodes` (grp, n, at, hash) with `block`, `up` (the block's node LEVELS above) and `path` to it.

    `at` numbers the n nodes of a group from 0. Level k has a node at each multiple of FAN ** k,
    so its siblings are found by lag and lead over that many rows and twice as many. The slot tells
    which of them lie before it, the run's length which after it; the first child hashes the
    parent. A window holds a block, which ends where a run ends at each of these levels, so that
    windows stay small however large a group is, and all levels share one exchange and one sort.
    A path has, per level that its group still needs, what stands before and after the node.
    """
    block = F.floor(F.col("at") / BLOCK)
    own = Window.partitionBy("grp", "block").orderBy("at")
    rows = nodes.select("*", block.alias("block"), F.col("hash").alias("up"))
    kept = nodes.columns
    steps: list[str] = []
    for level in range(LEVELS):
        width = FAN**level
        node, count = F.floor(F.col("at") / width), F.ceil(F.col("n") / width)
        slot = F.pmod(node, F.lit(FAN))
        run = F.least(F.lit(FAN), count - node + slot)
        rows = rows.select(
            "*",
            *[F.lag("up", width * k).over(own).alias(f"lag_{k}") for k in range(1, FAN)],
            *[F.lead("up", width * k).over(own).alias(f"lead_{k}") for k in range(1, FAN)],
        )
        # Only a node's first row stands for it, and only while its group has several nodes.
        first = (F.pmod("at", F.lit(width)) == 0) & (count > 1)
        nothing = F.lit("")
        before = F.concat(*[F.when(slot >= k, F.col(f"lag_{k}")).otherwise(nothing) for k in reversed(range(1, FAN))])
        after = F.concat(*[F.when(slot + k < run, F.col(f"lead_{k}")).otherwise(nothing) for k in range(1, FAN)])
        step = F.when(first, F.struct(before.alias("before"), after.alias("after")))
        rows = rows.select(*kept, "block", "up", *steps, step.alias(f"step_{level}"))
        parent = digest("up", f"step_{level}.after")
        rows = rows.withColumn("up", F.when(first & (slot == 0), parent).otherwise(F.col("up")))
        steps.append(f"step_{level}")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A node's step holds for the rows after its first as well; a group's needless levels are null and go.
    rows = rows.select(
        *kept, "block", F.first("up").over(so_far).alias("up"), *[F.last(s, True).over(so_far).alias(s) for s in steps]
    )
    return rows.select(*kept, "block", "up", F.array_compact(F.array(*steps)).cast(PATH).alias("path"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The passes over `nodes` (grp, n, at, hash), and the last node of each group (grp, at, hash).

    A pass takes LEVELS levels; the blocks' nodes are the next pass's. There are as many passes as the
    largest group needs.
    """
    passes = []
    while True:
        here = climbed(nodes)
        passes.append(here)
        blocks = here.filter(F.pmod("at", F.lit(BLOCK)) == 0)
        count, node = F.ceil(F.col("n") / BLOCK), F.col("block")
        nodes = frames.staged(blocks.select("grp", count.alias("n"), node.alias("at"), F.col("up").alias("hash")), "blocks")
        if nodes.filter("n > 1").isEmpty():
            return passes, nodes.select("grp", "at", "hash")


def descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first pass's nodes with their whole path and the further columns of `above` (grp, at, path, ...).

    `above` has a row per group, for its last node. Each pass takes over what its blocks' nodes have.
    """
    for here in reversed(passes):
        upper = above.withColumnsRenamed({"at": "block", "path": "rest"})
        inherited = [c for c in upper.columns if c not in ("grp", "block", "rest")]
        own = [c for c in here.columns if c not in ("n", "hash", "block", "up", "path")]
        joined = here.join(upper, ["grp", "block"])
        above = joined.select(*own, *inherited, F.concat("path", "rest").alias("path"))
        if here is not passes[0]:
            above = frames.staged(above, "paths")
    return above


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row of `docs`: its id, leaf, subroot, root, proof (an array of what stands before and after the
    node at each level), proof_sha256, folded_root and verified.

    A leaf is H of `fields`. Leaves of one group ascend by id; every FAN consecutive nodes become their
    H until one is left, the subroot; so do the subroots, ordered by group, until the root is left.
    `tampered` gives other values for some fields; folded_root is what the row's leaf with these
    gives with its siblings, and verified whether that is the root.

    One scan makes the leaves; ranks within groups come from `frames.ranked`. Texts aren't shuffled, and
    no group, however large, is in one task. Rows take the path above their block from the block's one row.

    A missing group comes first and is a group; a missing id comes first in its group; of equal ids the
    row whose leaf is smaller comes first, and of equal leaves any, which gives the same tree. Missing
    and empty texts differ. A group of one row has its leaf as subroot; a sole group's subroot is the root.
    An empty table gives an empty one. Columns that are no field play no part.
    """
    columns = {field: F.col(f"`{field}`") for field in fields}
    leaf, other = leaf_digest(*columns.values()), leaf_digest(*(columns | (tampered or {})).values())
    group = F.col(f"`{group_col}`")
    rows = docs.select(
        # Groups by code point, a missing one before all.
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("grp"),
        F.col(f"`{id_col}`").alias("id"),
        leaf.alias("hash"),
        F.nullif(other, leaf).alias("other"),
    )
    rows = frames.staged(frames.numbered(rows), "leaves")
    sizes = frames.staged(rows.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    placed = frames.ranked(rows, ["grp"], ["id", "hash"]).join(sizes, "grp")
    place = (F.col("rank") - 1).alias("at")
    passes, tops = climb(placed.select("grp", "n", place, "hash", "id", "other", F.col("hash").alias("leaf")))

    subroots = frames.staged(frames.numbered(tops.select("grp", "hash", F.lit(0).alias("one"))), "subroots")
    n_groups = F.lit(subroots.count()).cast("bigint").alias("n")
    ordered = frames.ranked(subroots, ["one"], ["grp"]).withColumnRenamed("grp", "own")
    group_passes, last = climb(ordered.select(F.lit("").alias("grp"), n_groups, place, "hash", "own"))
    empty = F.array().cast(PATH).alias("path")
    upper = descend(group_passes, last.select("grp", "at", empty, F.col("hash").alias("root")))
    upper = upper.select(F.col("own").alias("grp"), "path", "root")
    above = tops.select("grp", "at", F.col("hash").alias("subroot")).join(upper, "grp")

    found = descend(passes, frames.staged(above, "above"))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    start = F.coalesce("other", "leaf")
    folded = F.aggregate("path", start, lambda node, step: digest(step["before"], node, step["after"]))
    found = found.select(
        F.col("id").alias(id_col),
        *["leaf", "subroot", "root"],
        F.col("path").alias("proof"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return found.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))
