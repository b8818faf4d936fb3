"""Benchmark passages in documents, by greedy string tiling."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm import frames, shingles
from assetlens.llm.ngram_join import bit_table, held

#: A tile has so many words at least, or all of a shorter item.
TILE_WORDS = 3
COVERAGE = 0.8
#: Punctuation, symbols, spaces and controls beyond ASCII; no letters, digits or marks on them.
MARKS = r"[^\x00-\x7f\p{L}\p{M}\p{N}\p{Cs}\p{Co}\p{Cn}]+"


def runs(places: np.ndarray, seeds: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal matches as (number of seeds, place in the text, place in the item).

    Goes along the text's seeds with one counter per place of the item, so that memory doesn't grow
    with the number of matches.
    """
    at_seed = {seed: item == seed for seed in np.unique(item).tolist()}
    length, before = np.zeros(len(item) + 1, dtype=np.int64), -2
    for place, seed in zip(places.tolist(), seeds.tolist(), strict=True):
        now = np.zeros_like(length)
        if (matches := at_seed.get(seed)) is not None:
            now[1:][matches] = (length[:-1][matches] if place == before + 1 else 0) + 1
        ended = length[:-1] * ((now[1:] == 0) if place == before + 1 else True)
        yield from closed(ended, before)
        last = length[-1]
        if last:
            yield int(last), int(before - last + 1), int(len(item) - last)
        length, before = now, place
    yield from closed(length, before)


def closed(ended: np.ndarray, place: int) -> Iterator[tuple[int, int, int]]:
    for at in np.flatnonzero(ended):
        count = int(ended[at])
        yield count, place - count + 1, int(at) - count


def tiles(places: np.ndarray, seeds: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (words, place in the text, place in the item) of each tile.

    The longest match whose words are all unmarked is marked, again and again, until none has
    `least` words. A match that has lost words to a longer one goes back with what is left of it.
    Of equally long ones the first in the item goes first, then the first in the text. A match
    of the whole item leaves nothing to look for.
    """
    for at in np.flatnonzero(seeds[: max(0, len(seeds) - len(item) + 1)] == item[0]):
        end = at + len(item)
        if places[end - 1] - places[at] == len(item) - 1 and np.array_equal(seeds[at:end], item):
            return [(len(item) + least - 1, int(places[at]), 0)]
    heap = [(-(count + least - 1), there, here) for count, here, there in runs(places, seeds, item)]
    heapq.heapify(heap)
    marked_item: set[int] = set()
    marked_text: set[int] = set()
    found = []
    while heap:
        size, there, here = heapq.heappop(heap)
        free = [there + k not in marked_item and here + k not in marked_text for k in range(-size)]
        if all(free):
            found.append((-size, here, there))
            marked_item.update(range(there, there - size))
            marked_text.update(range(here, here - size))
            continue
        start = None
        for k, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = k
            elif not is_free and start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, there + start, here + start))
                start = None
    return found


def tile_of(words: int, least: int) -> list[int]:
    """The one length of an item's tiles; an item without words has none."""
    return [min(words, least)] if words else []


def seeded(lengths: Callable[[int], list[int]], table=None):
    """Arrow function over (key, text, id): per length of tiles, which `lengths` gives for a number of words,
    the places and seeds of each text, or with `table` of those held by it; without any, no row. Of equal texts
    of a task only the first has its seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            kept, words, tile, places, seeds = [], [], [], [], []
            for at, text in enumerate(shingles.texts_words(batch.column(1), shingles.IS_LETTER)):
                key = batch.column(0)[at].as_py()
                again = key in seen
                seen.add(key)
                for length in lengths(len(text)):
                    found = shingles.windows(text, length)
                    where = np.arange(len(found)) if table is None else np.flatnonzero(held(table.value, found))
                    if not len(where):
                        continue
                    kept.append(at)
                    words.append(len(text))
                    tile.append(length)
                    places.append(None if again else where)
                    seeds.append(None if again else found[where].view(np.int64))
            some = batch.take(pa.array(kept, pa.int64()))
            numbers, lists = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0),
                    some.column(2),
                    *[pa.array(values, numbers) for values in (words, tile)],
                    *[pa.array(values, lists) for values in (places, seeds)],
                ],
                ["key", "id", "words", "tile", "places", "seeds"],
            )

    return run


def with_seeds(rows: DataFrame, lengths: Callable[[int], list[int]], table=None) -> DataFrame:
    """key, id, words, tile, places and seeds of rows (id, text); seeds are hashes of `tile` words."""
    plain = F.length("text") == F.octet_length("text")
    spaced = F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", MARKS, " "))
    read = rows.select(F.unhex(F.sha2("text", 256)).alias("key"), spaced.alias("text"), "id")
    schema = T.StructType(
        [
            T.StructField("key", T.BinaryType()),
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("words", T.LongType()),
            T.StructField("tile", T.LongType()),
            T.StructField("places", T.ArrayType(T.LongType())),
            T.StructField("seeds", T.ArrayType(T.LongType())),
        ]
    )
    return read.mapInArrow(seeded(lengths, table), schema)


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of text and item: words covered, tiles and the longest one."""
    for batch in batches:
        covered, number, longest, spans = [], [], [], []
        for row in range(batch.num_rows):
            least = batch.column(2)[row].as_py()
            places, seeds, item = (batch.column(k)[row].values.to_numpy() for k in (3, 4, 5))
            found = tiles(places, seeds, item, least)
            covered.append(sum(t[0] for t in found))
            number.append(len(found))
            longest.append(max((t[0] for t in found), default=0))
            in_item = sorted(found, key=lambda t: t[1])
            spans.append(",".join(f"{here}:{there}:{size}" for size, here, there in in_item))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                *[pa.array(values, pa.int64()) for values in (covered, number, longest)],
                pa.array(spans, pa.string()),
            ],
            ["key", "item_key", "tile", "covered_words", "n_tiles", "longest_tile", "tiles"],
        )


TILED = (
    "key binary, item_key binary, tile bigint, covered_words bigint, n_tiles bigint, longest_tile bigint, tiles string"
)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = TILE_WORDS,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of a document and a test item whose words the document covers to `coverage` or more.

    Columns: id, item id, item_words, covered_words, coverage, n_tiles, longest_tile, tiles
    (place in the document:place in the item:words, by place), text_key. Words are runs of letters
    and digits, A-Z as a-z; punctuation, symbols and spaces of all scripts separate them. Tiles are
    matches of at least `least` words that share no word with each other on either side, the longest
    first, so passages whose parts are in another order count. An item of fewer words than a tile is
    one tile: it matches where all its words stand together.

    1. Seeds are hashes of as many words as a tile must have, rolled along texts and items. A bit
       table of the items' seeds, of fixed size, goes to all tasks; documents without a seed of it
       end there. One scan rolls all lengths of tiles that there are.
    2. Seeds of documents and items meet in a join. Pairs whose seeds, apart from each other, could
       not cover enough are left out.
    3. The matches of a pair are tiled in one task: its memory follows the item and the text's seeds.

    Equal texts are tiled once and equal items too; their rows get the same results. Missing and empty
    texts and items match nothing. Texts of any length are whole. Ids may be missing or repeat. Empty
    tables give an empty one; further columns are not read.
    """
    passages = items.select(F.col(item_id).alias("id"), frames.whole(F.col(item_text)).alias("text"))
    tests = frames.staged(with_seeds(passages, lambda words: tile_of(words, least)), "tests")
    unique = tests.filter("seeds IS NOT NULL").select(
        F.col("key").alias("item_key"), F.col("words").alias("item_words"), F.col("seeds").alias("item_seeds")
    )
    unique = frames.staged(unique.dropDuplicates(["item_key"]), "unique-tests")
    single = unique.select("item_key", "item_words", F.explode("item_seeds").alias("seed"))
    single = frames.staged(single, "item-seeds")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(single.select("seed")))
    used = sorted(row.tile for row in tests.select("tile").distinct().collect())  # `least` lengths at most

    texts = docs.select(F.col(id_col).alias("id"), frames.whole(F.col(text_col)).alias("text"))
    hits = frames.staged(with_seeds(texts, lambda words: [k for k in used if k <= words], table), "hits")
    # Tasks may have kept the seeds of equal texts each; one of them stands for all.
    own = F.any_value(F.struct("places", "seeds")).alias("own")
    first = hits.filter("seeds IS NOT NULL").groupBy("key", "tile").agg(own)
    first = frames.staged(first.select("key", "tile", "own.*"), "hit-texts")
    meeting = first.select("key", "tile", F.explode(F.array_distinct("seeds")).alias("seed")).join(single, "seed")
    pairs = meeting.groupBy("key", "tile", "item_key").agg(
        F.count("*").alias("n"), F.any_value("item_words").alias("item_words")
    )
    pairs = pairs.filter(F.col("n") * F.col("tile") >= F.col("item_words") * coverage)
    pairs = frames.staged(pairs.select("key", "tile", "item_key"), "leak-pairs")
    both = pairs.join(first, ["key", "tile"]).join(unique.select("item_key", "item_seeds"), "item_key")
    found = both.select("key", "item_key", "tile", "places", "seeds", "item_seeds").mapInArrow(tiled, TILED)
    share = F.col("covered_words") / F.col("item_words")
    found = found.join(unique.select("item_key", "item_words"), "item_key").withColumn("coverage", share)
    found = frames.staged(found.filter(F.col("coverage") >= coverage), "leaks")
    named = found.join(tests.select(F.col("key").alias("item_key"), F.col("id").alias("item")), "item_key")
    named = frames.staged(named, "named-leaks").join(hits.select("key", "tile", "id"), ["key", "tile"])
    return named.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id),
        *["item_words", "covered_words", "coverage", "n_tiles", "longest_tile", "tiles"],
        F.lower(F.hex("key")).alias("text_key"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **rule) -> DataFrame:
    """The rows of `docs` whose text covers no test item, with the columns of `docs`.

    Missing and empty texts stay, as do all rows where there are no items; equal texts stay or go
    together. Only hashes of texts are compared. A bitmap of fixed size tells which rows may have to go: only their
    texts are shuffled. Columns may bear any name; an empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"))
    text = frames.whole(F.col(f"row.`{text_col}`"))
    found = leaks(docs, items, text_col=text_col, **rule).select("text_key").distinct()
    found = frames.staged(found, "leaked")
    keyed = rows.withColumn("text_key", F.sha2(text, 256))
    asked = frames.with_possible(keyed, frames.slot_bitmaps(found), "text_key")
    stay = asked.filter("NOT possible").select("row.*")
    return stay.union(asked.filter("possible").join(found, "text_key", "left_anti").select("row.*"))
