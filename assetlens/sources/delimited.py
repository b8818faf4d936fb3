"""Delimited text files as grids, with the position of every record in its file.

Spark's delimited reader drops blank lines, and so shifts positions; hence lines are read as text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.session import staged

LINE_END = "\n"


class Dialect:
    """Patterns of fields. A field that begins with a quote runs to the closing one, doubled quotes
    included, and may have a plain tail; in any other a quote is a character like others. All
    repetitions are possessive: they run in loops, not recursively, however long a cell is."""

    def __init__(self, separator: str) -> None:
        if len(separator) != 1 or separator in '"\r\n':
            raise ValueError(f"{separator!r} cannot separate fields")
        self.separator = separator
        sep = re.escape(separator)
        self.inside = r'(?:[^"]++|"")*+'
        plain = f"[^{sep}]*+"
        self.field = rf'(?:"{self.inside}"{plain}|(?!"){plain})'
        some = f"(?:{self.field}{sep})*+"
        self.opens = rf'^{some}"{self.inside}\z'
        self.stays = rf'^{self.inside}(?:\z|"{plain}{sep}{some}"{self.inside}\z)'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as `path, pos, value`, positions from 0 per file.

    A line's number is its number within its split plus the lines of the splits before. Lines
    are numbered split by split, so a task holds one split of a file, never a whole file; what
    runs per file is a sum over its splits. The lines are staged first, because both parts must
    see the same splits.
    """
    fixed = staged(split_lines(spark, path))
    starts = fixed.groupBy("path", "block").agg(
        F.min("id").alias("first_id"), F.count("*").alias("lines")
    )
    before = (
        Window.partitionBy("path")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = starts.select(
        "path",
        "block",
        (F.sum("lines").over(before) - F.col("lines") - F.col("first_id")).alias("shift"),
    )
    return fixed.join(offsets, ["path", "block"]).select(
        "path", (F.col("id") + F.col("shift")).alias("pos"), "value"
    )


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they begin in and a number that grows within it.

    Lines end with a line feed; a carriage return before it stays a part of the line here.
    """
    return spark.read.option("lineSep", LINE_END).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def running(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def with_quote_states(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`steps` with `turned` and `fixed`: what the steps before, in `order` within `keys`, do together.

    A step takes a state, inside quotes (1) or not (0), to the next: either it sets the state (`sets`),
    to `adds`, or it adds `adds` to it modulo 2. Steps one after the other are such a step again: what
    counts is the last that sets the state, if any, and the sum since. `fixed` tells whether there is
    one, `turned` is the sum.
    """
    before = running(keys, order)
    summed = steps.withColumn("total", F.coalesce(F.sum("adds").over(before), F.lit(0)))
    at_set = F.last(F.when(F.col("sets"), F.col("total")), True).over(before)
    marked = summed.withColumn("at_set", at_set)
    since = F.col("total") - F.coalesce("at_set", F.lit(0))
    return (
        marked.withColumn("turned", F.pmod(since, F.lit(2)))
        .withColumn("fixed", F.col("at_set").isNotNull())
        .drop("total", "at_set")
    )


def records(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """Records as `path, pos, value, closed`, positions from 0 per file; a quoted line end is part of its record.

    Whether a line begins inside quotes depends on all lines before. Each line tells by itself where it
    leaves a reader that comes from inside or from outside; this is summed up within its split, then over
    the splits before, of which each contributes one row. So no task holds more than a split. Only the
    lines of records over several lines are brought together; a record has to fit into memory.
    """
    lines = split_lines(spark, path)
    bare = F.regexp_replace("value", r"\r\z", "")
    after_out, after_in = bare.rlike(dialect.opens), bare.rlike(dialect.stays)
    lines = lines.select("*", after_out.cast("int").alias("adds"), (after_out == after_in).alias("sets"))
    lines = staged(lines)
    stated = with_quote_states(lines, ["path", "block"], "id")
    # A whole split as one step: what stands before its last line, and that line.
    adds = F.when(F.col("sets"), F.col("adds")).otherwise((F.col("turned") + F.col("adds")) % 2)
    step = F.struct(adds.alias("adds"), (F.col("sets") | F.col("fixed")).alias("sets"))
    ends = stated.groupBy("path", "block").agg(F.max_by(step, "id").alias("step")).select("path", "block", "step.*")
    # Outside at the start of a file; what is summed up since then is the state itself.
    at_start = with_quote_states(ends, ["path"], "block").select("path", "block", F.col("turned").alias("came"))
    own = F.when(F.col("fixed"), F.col("turned")).otherwise((F.col("turned") + F.col("came")) % 2)
    inside = stated.join(at_start, ["path", "block"]).withColumn("inside", own)
    left = F.when(F.col("sets"), F.col("adds")).otherwise((F.col("inside") + F.col("adds")) % 2)
    inside = staged(
        inside.select("path", "block", "id", "value", (F.col("inside") == 1).alias("inside"), (left == 1).alias("left"))
    )
    # A record's number is how many lines before it begin outside.
    begins = (~F.col("inside")).cast("bigint")
    counts = inside.groupBy("path", "block").agg(F.sum(begins).alias("n"))
    shift = F.coalesce(F.sum("n").over(running(["path"], "block")), F.lit(0))
    upto = Window.partitionBy("path", "block").orderBy("id")
    placed = inside.withColumn("nth", F.sum(begins).over(upto)).join(
        counts.select("path", "block", shift.alias("shift")), ["path", "block"]
    )
    placed = placed.withColumn("pos", F.col("shift") + F.col("nth") - 1)
    alone = ~F.col("inside") & ~F.col("left")
    whole = placed.where(alone).select("path", "pos", "value", F.lit(True).alias("closed"))
    parts = placed.where(~alone).groupBy("path", "pos").agg(
        F.sort_array(F.collect_list(F.struct("block", "id", "value", "left"))).alias("lines")
    )
    joined = parts.select(
        "path",
        "pos",
        F.array_join(F.transform("lines", lambda line: line["value"]), LINE_END).alias("value"),
        (~F.element_at("lines", -1)["left"]).alias("closed"),
    )
    return whole.unionByName(joined).withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def fields(value: Column, dialect: Dialect) -> Column:
    """The cells of a record; an empty cell is null."""
    sep = dialect.separator

    def content(found: Column) -> Column:
        bare = F.substr(found, F.lit(2))
        inner = F.regexp_extract(bare, rf'^"({dialect.inside})"', 1)
        # What is left after the two quotes that enclose the inner part is its tail.
        tail = F.substr(bare, F.length(inner) + 3)
        quoted = F.concat(F.replace(inner, F.lit('""'), F.lit('"')), tail)
        return F.nullif(F.when(bare.startswith('"'), quoted).otherwise(bare), F.lit(""))

    found = F.regexp_extract_all(F.concat(F.lit(sep), value), F.lit(f"{re.escape(sep)}{dialect.field}"), F.lit(0))
    return F.transform(found, content)


def delimited_grid(
    spark: SparkSession, path: str, separator: str = ",", sheet: str = "Assets"
) -> DataFrame:
    """Files as one-sheet grids, every record to its own width.

    Cells are those of the usual quoting: a quoted cell may hold separators, doubled quotes and line ends.
    Blank lines are records without cells. A quote that is open at the end of a file is an error.
    """
    dialect = Dialect(separator)
    closed = F.when(F.col("closed"), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("a quote is left open in "), "path"))
    )
    rows = records(spark, path, dialect).withColumn("value", closed)
    parsed = rows.select("path", "pos", fields(F.col("value"), dialect).alias("cells"))
    width_of = F.array_max(
        F.transform("cells", lambda v, i: F.when(v.isNotNull(), i + 1).otherwise(F.lit(0)))
    )
    return parsed.withColumn("width", width_of).select(
        "path",
        F.lit(sheet).alias("sheet"),
        "pos",
        "width",
        F.slice("cells", F.lit(1), F.col("width")).alias("cells"),
    )
