"""Ranked lexical search: best-first document intervals, bounded by range maxima of posting lists."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm import frames, shingles
from assetlens.llm.ngram_join import bit_table, held

TOP = 50
#: A block of the index ends with the document that brings it to so many term occurrences or documents.
BLOCK_TERMS = 1 << 19
BLOCK_DOCS = 1 << 16
#: Items are searched for in batches of about so many distinct terms; a batch is sent to all tasks.
BATCH_TERMS = 1 << 18
#: So many of an item's best intervals are split at a time.
SPLIT_TOGETHER = 32
#: Stands for a missing id, before all others.
NO_ID = -(1 << 63)
BLOCK = """
    n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, terms array<bigint>, dfs array<int>,
    docs array<int>, tfs array<int>
"""


def indexed(table: np.ndarray):
    """An Arrow function over (id, text): blocks of the index, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Block()
        for batch in batches:
            ids = batch.column(0)
            for at, words in enumerate(shingles.texts_words(batch.column(1), shingles.IS_LETTER)):
                builder.add(ids[at].as_py(), words, held(table, words))
                if builder.size >= BLOCK_TERMS or len(builder.ids) >= BLOCK_DOCS:
                    yield builder.row()
                    builder = Block()
        if builder.n_docs:
            yield builder.row()

    return run


class Block:
    """Posting lists of some documents, as they come in."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = self.size = 0
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.words: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: np.ndarray, wanted: np.ndarray) -> None:
        if not len(words):
            return
        self.n_docs += 1
        self.n_terms += len(words)
        if wanted.any():
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.lengths.append(len(words))
            self.words.append(words[wanted])
            self.size += len(self.words[-1])

    def row(self) -> pa.RecordBatch:
        """Documents by id; per term, in the order of hashes, its documents and how often it occurs there."""
        ids = np.array(self.ids, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        words = np.concatenate([np.empty(0, dtype=np.uint64), *self.words])
        terms, term = np.unique(words, return_inverse=True)
        doc = np.repeat(place, [len(w) for w in self.words]) if self.words else np.empty(0, dtype=np.int64)
        cells, tfs = np.unique(term * max(len(ids), 1) + doc, return_counts=True)
        owner, docs = np.divmod(cells, max(len(ids), 1))
        lists = [
            (ids[order], pa.int64()),
            (np.array(self.lengths, dtype=np.int64)[order], pa.int64()),
            (terms.view(np.int64), pa.int64()),
            (np.bincount(owner, minlength=len(terms)), pa.int32()),
            (docs, pa.int32()),
            (tfs, pa.int32()),
        ]
        columns = [pa.array([n], pa.int64()) for n in (self.n_docs, self.n_terms)]
        columns += [pa.ListArray.from_arrays([0, len(a)], pa.array(a, kind)) for a, kind in lists]
        return pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "ids", "lengths", "terms", "dfs", "docs", "tfs"])


def whole_number(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


class Postings:
    """A block's lists of the terms asked for, with a sparse table of range maxima over each list.

    An entry is a posting's impact with its place, so that a maximum tells where it stands; of equal
    impacts the first counts. Level j of the table has the maximum of 2 ** j entries from each on; what
    runs over the end of a list is never asked for.
    """

    def __init__(self, batch: pa.RecordBatch, row: int, weights: tuple[np.ndarray, np.ndarray], totals: tuple[int, int]):
        terms = whole_number(batch, "terms", row).view(np.uint64)
        dfs = whole_number(batch, "dfs", row).astype(np.int64)
        docs = whole_number(batch, "docs", row).astype(np.int64)
        tfs = whole_number(batch, "tfs", row).astype(np.int64)
        lengths = whole_number(batch, "lengths", row)
        self.ids = whole_number(batch, "ids", row)
        n_docs, n_terms = totals
        known, weight = weights
        at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
        asked = (known[at] == terms) if len(known) else np.zeros(len(terms), dtype=bool)
        mine = np.repeat(asked, dfs)
        self.terms, sizes = terms[asked], dfs[asked]
        self.docs, tfs = docs[mine], tfs[mine]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        slack = 50 + (50 * lengths * n_docs) // max(n_terms, 1)
        impact = 1_000_000_000 * tfs // (1000 * tfs + 20 * slack[self.docs])
        impact *= np.repeat(weight[at[asked]] if len(known) else np.empty(0, np.int64), sizes)
        count = len(self.docs)
        self.impact, self.bits = impact, max(count, 1).bit_length()
        self.last = (1 << self.bits) - 1
        self.cells = np.repeat(np.arange(len(sizes)), sizes) * max(len(self.ids), 1) + self.docs
        self.levels = [impact << self.bits | (self.last - np.arange(count))]
        width = 1
        while 2 * width <= (int(sizes.max()) if len(sizes) else 0):
            above = self.levels[-1].copy()
            above[:-width] = np.maximum(above[:-width], self.levels[-1][width:])
            self.levels.append(above)
            width *= 2
        self.table = np.stack(self.levels)
        del self.levels

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The largest entry of each range, none of them empty."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        return np.maximum(self.table[level, begin], self.table[level, end - (1 << level)])

    def best(self, found: list[tuple[int, int]], terms: np.ndarray, top: int) -> None:
        """Enter the block's documents into `found`, a heap of the best (score, -id) so far.

        The interval of all documents goes first. The interval with the largest bound is split at the
        document that has the largest impact of any term in it: that document is scored, and the parts
        before and after it are bounded by the sum of the maxima of the terms' ranges. An interval
        that can't better the last of `found` any more is dropped; of equal scores the smaller id is better.
        Some of the best intervals are split together, which visits a few more than one by one would.
        """
        at = np.flatnonzero(np.isin(self.terms, terms, assume_unique=True))
        if not len(at):
            return
        agenda: list[tuple] = []
        self.enter(agenda, found, top, at, self.starts[at], self.ends[at], np.array([0]), np.zeros(1, dtype=np.int64))
        while agenda:
            some = []
            while agenda and len(some) < SPLIT_TOGETHER:
                interval = heapq.heappop(agenda)
                if self.hopeful(found, top, -interval[0], interval[1]):
                    some.append(interval)
                elif -interval[0] < found[0][0]:
                    agenda.clear()  # no bound is larger
            if not some:
                break
            lanes = [len(i[3]) for i in some]
            first = np.cumsum([0, *lanes[:-1]])
            term, begin, end = (np.concatenate([i[k] for i in some]) for k in (3, 4, 5))
            split = np.array([i[2] for i in some])
            doc = np.repeat(split, lanes)
            cut = np.searchsorted(self.cells, term * len(self.ids) + doc)
            there = cut < end
            there[there] = self.docs[cut[there]] == doc[there]
            scores = np.zeros(len(term), dtype=np.int64)
            scores[there] = self.impact[cut[there]]
            for score, d in zip(np.add.reduceat(scores, first).tolist(), split.tolist(), strict=True):
                entry = (score, -int(self.ids[d]))
                if score > 0 and len(found) < top:
                    heapq.heappush(found, entry)
                elif score > 0 and entry > found[0]:
                    heapq.heapreplace(found, entry)
            low = np.array([i[1] for i in some])
            self.enter(agenda, found, top, term, begin, cut, first, low)
            self.enter(agenda, found, top, term, cut + there, end, first, split + 1)

    def enter(self, agenda, found, top, term, begin, end, first, low) -> None:
        """Put intervals into the agenda: (-bound, first document, where to split, terms, ranges)."""
        owner = np.repeat(np.arange(len(first)), np.diff(first, append=len(term)))
        some = np.flatnonzero(begin < end)
        if not len(some):
            return
        term, begin, end, owner = term[some], begin[some], end[some], owner[some]
        entries = self.maxima(begin, end)
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        bounds = np.add.reduceat(entries >> self.bits, start).tolist()
        splits = self.docs[self.last - (np.maximum.reduceat(entries, start) & self.last)].tolist()
        lows, stops = low[owner[start]].tolist(), [*start[1:].tolist(), len(owner)]
        for bound, split, lowest, a, b in zip(bounds, splits, lows, start.tolist(), stops, strict=True):
            if self.hopeful(found, top, bound, lowest):
                heapq.heappush(agenda, (-bound, lowest, split, term[a:b], begin[a:b], end[a:b]))

    def hopeful(self, found: list[tuple[int, int]], top: int, bound: int, lowest: int) -> bool:
        if bound <= 0:
            return False
        return len(found) < top or (bound, -int(self.ids[lowest])) > found[0]


def searched(batch, top: int):
    """An Arrow function over blocks of the index: per item of the batch the task's best documents."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, totals = batch.value
        found: list[list[tuple[int, int]]] = [[] for _ in items]
        for block in blocks:
            for row in range(block.num_rows):
                postings = Postings(block, row, weights, totals)
                for best, (_, terms) in zip(found, items, strict=True):
                    postings.best(best, terms, top)
        for best, (number, _) in zip(found, items, strict=True):
            if best:
                scores, ids = zip(*best, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(best), pa.int64()),
                        pa.array([None if i == -NO_ID else -i for i in ids], pa.int64()),
                        pa.array(scores, pa.int64()),
                    ],
                    ["number", "id", "score"],
                )

    return run


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number and distinct terms of each item."""
    for batch in batches:
        terms = [np.unique(w).view(np.int64) for w in shingles.texts_words(batch.column(1), shingles.IS_LETTER)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], ["number", "terms"])


def batches_of(items: DataFrame) -> tuple[DataFrame, int]:
    """`items` with `batch`, and how many batches there are, none of much more than BATCH_TERMS but for one item."""
    total, largest = items.agg(F.sum(F.size("terms")), F.max(F.size("terms"))).first()
    count = -(-(total or 0) // BATCH_TERMS)
    while True:
        dealt = items.withColumn("batch", F.pmod(F.xxhash64("number"), F.lit(max(count, 1))))
        sizes = dealt.groupBy("batch").agg(F.sum(F.size("terms")).alias("n"))
        if count <= 1 or sizes.agg(F.max("n")).first()[0] <= 2 * max(BATCH_TERMS, largest):
            return dealt, count
        count *= 2


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * df + 1)))


def search(
    items: DataFrame,
    docs: DataFrame,
    item_col: str = "item_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """item id, rank, document id, score: the `top` best documents of `docs` for each row of `items`.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z; a 64-bit hash stands for a term.

    1. One scan of whole texts makes the index, written to the shared folder: blocks of posting lists,
       of bounded size, of the terms that items may have, which a bit table of 16 MB tells. It also
       counts documents and terms; document frequencies are sums over the blocks' lists.
    2. Items go to all tasks in batches of bounded size. For each block and item the best
       documents are searched for by intervals (`Postings.best`); what a task has found so far for an
       item bounds the search in its further blocks. Each task returns at most `top` rows per item.
    3. The rows of all tasks are ranked per item.

    Scores are exact, and equal ones go by ascending id, a missing id first. Documents without terms,
    empty and missing texts count nowhere; items without terms or matches have no rows. Repeated
    documents each count and rank; a repeated item has rows once per repetition. Long texts are whole; one
    document is never split between blocks. Empty tables give an empty one; further columns are not read.
    """
    spark = docs.sparkSession
    asked = frames.numbered(items.select(F.col(item_col).alias("item"), frames.whole(F.col(text_col)).alias("text")))
    asked = frames.staged(asked, "items")
    terms = frames.staged(
        asked.select("marker", "text").mapInArrow(item_terms, "number bigint, terms array<bigint>"), "item-terms"
    )
    distinct = frames.staged(terms.select(F.explode("terms").alias("term")).distinct(), "query-terms")
    table = spark.sparkContext.broadcast(bit_table(distinct))

    read = docs.select(F.col(id_col).cast("bigint").alias("id"), frames.whole(F.col(text_col)).alias("text"))
    index = frames.staged(read.mapInArrow(lambda b: indexed(table.value)(b), BLOCK), "index")
    totals = tuple(n or 0 for n in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    lists = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("list"))
    dfs = lists.groupBy(F.col("list.terms").alias("term")).agg(F.sum("list.dfs").alias("df"))
    weights = dfs.join(distinct, "term", "left_semi").select("term", weight(F.col("df"), totals[0]).alias("weight"))
    weights = frames.staged(weights.filter("weight > 0"), "weights")

    dealt, count = batches_of(terms)
    matched = dealt.select("batch", "number", F.explode("terms").alias("term")).join(weights, "term")
    matched = frames.staged(matched, "matched")
    rows = spark.createDataFrame([], "number bigint, id bigint, score bigint")
    for number in range(count):
        batch = spark.sparkContext.broadcast(batch_values(matched.filter(F.col("batch") == number), totals))
        rows = rows.union(index.mapInArrow(searched(batch, top), rows.schema))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc("id"))
    ranked = frames.staged(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), "found")
    named = asked.select(F.col("marker").alias("number"), "item").join(ranked, "number")
    return named.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def batch_values(matched: DataFrame, totals: tuple[int, int]) -> tuple:
    """Items of one batch with their terms, the terms' weights, and the totals."""
    rows = matched.select("number", "term", "weight").toArrow()
    number, term, weight = (rows[c].to_numpy() for c in ("number", "term", "weight"))
    term = term.view(np.uint64)
    order = np.argsort(number, kind="stable")
    numbers, first = np.unique(number[order], return_index=True)
    items = list(zip(numbers.tolist(), np.split(term[order], first[1:]), strict=True)) if len(numbers) else []
    known, at = np.unique(term, return_index=True)
    return items, (known, weight[at]), totals
