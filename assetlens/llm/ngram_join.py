"""Documents whose word shingles are alike, by a token-group matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm import frames, shingles
from assetlens.llm.components import components

#: A group takes sets of about so many tokens in all, or one larger set.
GROUP_TOKENS = 16_384
#: A token is demoted in the order of tokens if more sets than this have it among their first.
FEW = 4
#: Tokens are counted over so many times the first tokens: some come first only once others are demoted.
LOOKED_AT = 1.5
#: A group meets so many hubs, those with the most cells in common; what they leave apart meets later.
HUBS_PER_GROUP = 4
#: Linked sets must have one first token in common, and one more for so many tokens they have.
TOKENS_PER_COMMON = 20
SLOTS = 24
#: A group meets about so many sets that ask it at a time.
SETS_PER_CHUNK = 64
#: Frequent tokens are told apart up to this logarithm of their number.
TOP_LEVEL = 31
#: Bits of the tables that tell which tokens and sets may matter: 16 MB each.
TABLE_BITS = 27
#: Rows of a class, and so of copies of one text, that may meet in one task.
ROWS_PER_SLICE = 100_000
FLUSH_BYTES = 4 << 20
#: Tokens are counted so many bytes of sets at a time before Spark sums the counts.
COUNTED_BYTES = 8 << 20


def set_address(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(n: int, per_cent: int) -> int:
    """Tokens that a set of n must share with any set it is linked with."""
    return -(-per_cent * n // 100)


def common(n: int) -> int:
    return 1 + n // TOKENS_PER_COMMON


def first_count(count: int, per_cent: int) -> int:
    return count - needed(count, per_cent) + common(count)


def first_tokens(tokens: np.ndarray, per_cent: int, demoted: np.ndarray) -> np.ndarray:
    """As many tokens as may be missing, and `common(n)` more: so many any linked set has among its own.

    Of two sizes the smaller number holds, as each set's first tokens include those for it.
    They come first in the order of (times demoted, hash). Any order finds all links, as long as
    it is the same for all sets; one with frequent tokens last finds few others.
    """
    level = demoted[tokens >> np.uint64(64 - SLOTS)]
    return tokens[np.lexsort((tokens, level))[: first_count(len(tokens), per_cent)]]


def over_sets(size: int, make, columns: list[pa.Field]):
    """An Arrow function over texts: `make(address, set)` gives a row or None, once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for words in shingles.texts_words(batch.column(0)):
                tokens = shingles.shingle_set(words, size)
                if not len(tokens) or (address := set_address(tokens)) in seen:
                    continue
                seen.add(address)
                if (row := make(address, tokens)) is not None:
                    rows.append(row)
                    held += row[-1].nbytes
                if held > FLUSH_BYTES:
                    yield batch_of(rows, columns)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows, columns)

    return run


def batch_of(rows: list[tuple], columns: list[pa.Field]) -> pa.RecordBatch:
    """Rows whose last value is an array of tokens."""
    arrays = [r[-1] for r in rows]
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))
    plain = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(columns[:-1])]
    return pa.RecordBatch.from_arrays([*plain, lists], [f.name for f in columns])


ADDRESS = pa.field("cls", pa.binary())
TOKENS = pa.field("tokens", pa.list_(pa.int64()))


def token_counts(size: int, per_cent: int):
    """An Arrow function over texts: token and n, counted over some sets at a time, each once per task."""

    def counted(firsts: list[np.ndarray], others: list[np.ndarray]) -> pa.RecordBatch:
        (token, n), (other, m) = (np.unique(np.concatenate(some), return_counts=True) for some in (firsts, others))
        token, n = np.concatenate([token, other[m > FEW]]), np.concatenate([n, m[m > FEW]])
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        firsts, others, held = [], [], 0
        for batch in batches:
            for words in shingles.texts_words(batch.column(0)):
                tokens = shingles.shingle_set(words, size)
                if not len(tokens) or (address := set_address(tokens)) in seen:
                    continue
                seen.add(address)
                looked_at = int(LOOKED_AT * first_count(len(tokens), per_cent))
                firsts.append(tokens[:looked_at])
                others.append(tokens[looked_at:])
                held += tokens.nbytes
                if held > COUNTED_BYTES:
                    yield counted(firsts, others)
                    firsts, others, held = [], [], 0
        if firsts:
            yield counted(firsts, others)

    return run


def demotions(texts: DataFrame, size: int, per_cent: int) -> np.ndarray:
    """How late tokens come in the order, by the top bits of their hash: a table of fixed size, 16 MB.

    The tokens that come first by hash alone, and some after them, are counted over all sets (more
    than once, if tasks share copies of a set); all others where sets read one after another have them more than
    FEW times, as those of a cluster of changed copies, in which nearly all tokens are frequent. A frequent one is demoted by the logarithm of its count;
    of tokens with the same top bits the most frequent counts. Spark makes a bitmap per level of these, so that
    the driver gets no tokens, and no more than the bitmaps however many tokens there are. The table
    is a hint: whatever it holds, the links are the same.
    """
    counts = texts.mapInArrow(token_counts(size, per_cent), "token bigint, n bigint")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    slot = F.shiftrightunsigned("token", 64 - SLOTS)
    level = F.least(F.floor(F.log2("n")).cast("int"), F.lit(TOP_LEVEL))
    levels = counts.filter(F.col("n") > FEW).groupBy(slot.alias("slot")).agg(F.max(level).alias("level"))
    at = F.col("slot") + 1
    bitmaps = levels.groupBy("level", F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    demoted = np.zeros(1 << SLOTS, dtype=np.uint8)
    with frames.small_batches(texts.sparkSession):
        rows = bitmaps.collect()
    for row in rows:
        bits = np.unpackbits(np.frombuffer(bytes(row.bits), np.uint8), bitorder="little")
        demoted[(row.bucket - 1) * len(bits) :][: len(bits)][bits == 1] = row.level
    return demoted


def firsts(texts: DataFrame, size: int, per_cent: int, demoted: np.ndarray) -> DataFrame:
    """cls and first tokens of each set."""
    order = texts.sparkSession.sparkContext.broadcast(demoted)

    def make(address: bytes, tokens: np.ndarray) -> tuple | None:
        return address, first_tokens(tokens, per_cent, order.value)

    return texts.mapInArrow(over_sets(size, make, [ADDRESS, TOKENS]), "cls binary, tokens array<bigint>")


def only_held(sets: DataFrame, table: np.ndarray) -> DataFrame:
    """`sets` (cls, tokens) with only those tokens that the table may hold, and their ranks; without sets that have none."""
    kept = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy().view(np.uint64)
            there = held(kept.value, tokens)
            before = np.append(0, np.cumsum(there))
            counts = lists.value_lengths().to_numpy()
            starts = np.append(0, np.cumsum(counts))
            rank = np.arange(len(tokens), dtype=np.int32) - np.repeat(starts[:-1], counts).astype(np.int32)
            ends = before[starts]
            at = pa.array(ends.astype(np.int32))
            some = [pa.ListArray.from_arrays(at, pa.array(v[there])) for v in (tokens.view(np.int64), rank)]
            out = pa.RecordBatch.from_arrays([batch.column(0), *some], ["cls", "tokens", "ranks"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return sets.mapInArrow(run, "cls binary, tokens array<bigint>, ranks array<int>")


def linked(
    queries: list[tuple[bytes, np.ndarray]], group: list[tuple[bytes, np.ndarray]], per_cent: int, own: bool
) -> Iterator[tuple[int, int]]:
    """Pairs (query, member) that link; `own` if the queries are the group's members.

    The overlap of a query with the union of the group's tokens bounds that with each member. Only
    if the bound, taken with the smallest member's size, allows a link is the group opened: the
    rows of its token-member matrix that the query has are added up.
    """
    tokens = np.concatenate([t for _, t in group])
    member = np.repeat(np.arange(len(group)), [len(t) for _, t in group])
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    union, start = np.unique(tokens, return_index=True)
    stop = np.append(start[1:], len(tokens))
    sizes = np.array([len(t) for _, t in group])
    smallest = sizes.min()
    for at, (_, query) in enumerate(queries):
        where = np.searchsorted(union, query)
        where[where == len(union)] = 0
        rows = where[union[where] == query]
        overlap = len(rows)
        if 100 * overlap < per_cent * (len(query) + max(smallest - overlap, 0)):
            continue
        lengths = stop[rows] - start[rows]
        cells = np.repeat(start[rows] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        common = np.bincount(member[cells], minlength=len(group))
        for other in np.flatnonzero(100 * common >= per_cent * (len(query) + sizes - common)):
            if not own or at < other:
                yield at, int(other)


def verified(per_cent: int):
    """Links between and within groups: as many of them as span their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [members(batch.column(k)[row]) for k in (0, 1)]
                own = not sides[1]
                queries, group = sides[0], sides[0] if own else sides[1]
                names = [name for name, _ in queries] + ([] if own else [name for name, _ in group])
                shift = 0 if own else len(queries)
                parent, edges = list(range(len(names))), []

                def root(x: int, parent: list[int] = parent) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for query, other in linked(queries, group, per_cent, own):
                    x, y = root(query), root(other + shift)
                    if x != y:
                        parent[x] = y
                        edges.append((names[query], names[other + shift]))
                if edges:
                    a, b = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def members(group: pa.ListScalar) -> list[tuple[bytes, np.ndarray]]:
    rows = group.values
    names, sets = rows.field("cls"), rows.field("tokens")
    return [(names[k].as_py(), sets[k].values.to_numpy().view(np.uint64)) for k in range(len(rows))]


def bit_table(numbers: DataFrame) -> np.ndarray:
    """A bit for the low bits of each of the numbers in the one column: 16 MB, however many numbers."""
    slot = F.pmod(F.col(numbers.columns[0]), F.lit(1 << TABLE_BITS)) + 1
    rows = (
        numbers.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    for row in rows:
        table[(row.bucket - 1) * 4096 :][:4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return table


def held(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers may be in the table; all that are, and few others while it is sparse."""
    slot = numbers & np.uint64((1 << TABLE_BITS) - 1)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def in_groups(classes: DataFrame) -> DataFrame:
    """cls, number, n, band, comp and group of each class (with `root`, of a component known so far, or null).

    Classes of one component and about the same size make a group; so do classes of none that have
    the same smallest token. Large ones are cut by the classes' address.
    """
    keys = ["comp", "near", "band"]
    classes = classes.withColumn("comp", F.when(F.col("root").isNotNull(), F.xxhash64("root")))
    classes = classes.withColumn("near", F.when(F.col("root").isNull(), F.col("low")))
    large = classes.groupBy(*keys).agg(F.sum("n").alias("total")).filter(F.col("total") > GROUP_TOKENS)
    large = frames.staged(large.select(*keys, F.ceil(F.col("total") / GROUP_TOKENS).alias("slices")), "large").alias("large")
    same = [F.col(f"classes.{k}").eqNullSafe(F.col(f"large.{k}")) for k in keys]
    part = F.pmod(F.xxhash64("cls"), F.coalesce("slices", F.lit(1)))
    joined = classes.alias("classes").join(large, same, "left").select("classes.*", part.alias("part"))
    return frames.staged(joined.select("cls", "number", "n", "band", "comp", F.xxhash64(*keys, "part").alias("group")), "groups")


def opened_sets(texts: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """cls and tokens of the classes in `wanted`, read from the texts; a bit table spares most others."""
    address = F.conv(F.hex(F.substring("cls", 1, 4)), 16, 10).cast("bigint")
    opened = texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select(address.alias("number"))))

    def make(address: bytes, tokens: np.ndarray) -> tuple | None:
        number = np.array([int.from_bytes(address[:4], "big")], dtype=np.uint64)
        return (address, tokens) if held(opened.value, number)[0] else None

    sets = texts.mapInArrow(over_sets(size, make, [ADDRESS, TOKENS]), "cls binary, tokens array<bigint>")
    return sets.groupBy("cls").agg(F.any_value("tokens").alias("tokens"))


def with_cells(found: DataFrame, grouped: DataFrame, per_cent: int) -> DataFrame:
    """A cell (cls, n, group, band, comp, token, reach) per first token of each set.

    Linked sets of nx and ny tokens share ceil(per_cent * (nx + ny) / (100 + per_cent)) at least. So many of
    them stand after a set's first common ones in the order of tokens, that a token of the given rank is among those
    with sets of at most `reach` tokens only.
    """
    last = F.col("n") - F.col("cell.ranks") + F.floor(F.col("n") / TOKENS_PER_COMMON)
    reach = F.floor(last * (100 + per_cent) / per_cent + 1e-6).cast("bigint") - F.col("n")
    one = found.join(grouped, "cls").withColumn("cell", F.explode(F.arrays_zip("tokens", "ranks")))
    return one.select("cls", "n", "group", "band", "comp", F.col("cell.tokens").alias("token"), reach.alias("reach"))


def enough_cells(cells: DataFrame, width: float, keys: list[str], bands: tuple[str, str]) -> DataFrame:
    """`keys` and n of joined cells that have n tokens in common, as many as linked sets of these bands must."""
    # All sets of a group are at least as large as its band begins.
    smaller = F.floor(F.exp(F.least(*bands) * width) * (1 - 1e-9))
    found = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.min(smaller).alias("smaller"))
    return found.filter(F.col("n") >= 1 + F.floor(F.col("smaller") / TOKENS_PER_COMMON)).select(*keys, "n")


def met(sets: DataFrame, keys: list[str], per_cent: int) -> DataFrame:
    """Links of the sets (`keys`, cls, tokens, side 0 or 1) that meet under the same keys."""
    listed = [F.collect_list(F.when(F.col("side") == k, F.struct("cls", "tokens"))).alias(f"side_{k}") for k in (0, 1)]
    meeting = sets.groupBy(*keys).agg(*listed).select("side_0", "side_1")
    return frames.staged(meeting.mapInArrow(verified(per_cent), "a binary, b binary"), "links")


def through_hubs(
    texts: DataFrame, found: DataFrame, grouped: DataFrame, size: int, per_cent: int, width: float
) -> DataFrame:
    """node and root of components that links with hubs show; there may be more links.

    Hubs of a token are, of the sets that have it among their first tokens, the one whose first tokens are
    shared with others most, by its size, and the one with the smallest number. Of a cluster of changed copies the
    former has changed least, so that most others link with it. Each group meets the few hubs that it has the most cells in common with,
    all at once, so that its sets move once and the work grows with the number of cells and sets. A cluster of sets that are all alike becomes one component, without
    the pairs of its groups.
    """
    share = F.round(F.size("tokens") / F.col("n"), 3).cast("float").alias("share")
    cells = found.join(grouped, "cls").select("number", "group", "band", share, F.explode("tokens").alias("token"))
    central = F.max_by(F.struct("number", "band"), F.struct("share", "number"))
    both = F.array(F.min(F.struct("number", "band")), central)
    hubs = cells.groupBy("token").agg(both.alias("hubs"), F.count("*").alias("n")).filter("n > 1")
    hubs = frames.staged(hubs.select("token", F.explode(F.array_distinct("hubs")).alias("hub")), "hubs")
    frames.forget_shuffles(texts.sparkSession)
    named = hubs.select("token", F.col("hub.number").alias("hub"), F.col("hub.band").alias("hub_band"))
    shared = cells.select("group", "band", "token").distinct().join(named, "token")
    shared = shared.filter("abs(band - hub_band) <= 1")
    best = Window.partitionBy("group").orderBy(F.desc("n"), "hub")
    ends = enough_cells(shared, width, ["hub", "group"], ("band", "hub_band")).withColumn("nth", F.row_number().over(best))
    ends = frames.staged(ends.filter(F.col("nth") <= HUBS_PER_GROUP).select("hub", "group"), "hub-ends")
    frames.dropped(hubs)
    frames.forget_shuffles(texts.sparkSession)
    hub = ends.select(F.col("hub").alias("number")).distinct().withColumn("is_hub", F.lit(True))
    meeting = ends.select("group").distinct().withColumn("meets", F.lit(True))
    wanted = grouped.select("cls", "number", "group").join(hub, "number", "left").join(meeting, "group", "left")
    wanted = frames.staged(wanted.filter("is_hub OR meets"), "hub-wanted")
    sets = frames.staged(opened_sets(texts, size, wanted).join(wanted, "cls"), "hub-sets")
    frames.forget_shuffles(texts.sparkSession)
    hub_sets = sets.filter("is_hub").select(F.col("number").alias("hub"), "cls", "tokens")
    one = ends.join(hub_sets, "hub").select("group", "cls", "tokens", F.lit(0).alias("side"))
    two = sets.filter("meets").select("group", "cls", "tokens", F.lit(1).alias("side"))
    links = met(one.union(two), ["group"], per_cent)
    frames.dropped(ends, wanted, sets)
    frames.forget_shuffles(texts.sparkSession)
    return components(links)


def between_owners(cells: DataFrame) -> DataFrame:
    """`cells` without those whose token is in one component only, or in one group of none: no candidates meet there.

    A bitmap of fixed size tells which tokens may be in several; it lets some others pass, which only cost time.
    """
    owner = F.coalesce("comp", "group")
    owners = cells.groupBy("token").agg(F.min(owner).alias("least"), F.max(owner).alias("most"))
    several = frames.slot_bitmaps(owners.filter("least != most").select("token"))
    return frames.with_possible(cells, several, "token").filter("possible").drop("possible")


def candidates(cells: DataFrame, width: float) -> DataFrame:
    """Sets and groups (cls, group) of `cells` (`with_cells`) that have enough cells in common.

    A set meets the union of a group's first tokens, not the group's sets, where their sizes are in reach of each
    other. Groups of one component so far don't meet, and of two groups the one with the smaller number asks.
    """
    unions = cells.groupBy("group", "band", "comp", "token").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    one, two = cells.alias("one"), unions.alias("two")
    apart = F.coalesce(F.col("one.comp") != F.col("two.comp"), F.lit(True))
    near = F.abs(F.col("one.band") - F.col("two.band")) <= 1
    ordered = F.col("one.group") < F.col("two.group")
    reached = (F.col("one.n") <= F.col("two.reach")) & (F.col("two.n") <= F.col("one.reach"))
    pairs = one.join(two, (F.col("one.token") == F.col("two.token")) & ordered & near & apart & reached)
    pairs = pairs.select(
        "cls", F.col("two.group").alias("group"), F.col("one.band").alias("own_band"), F.col("two.band").alias("band")
    )
    return enough_cells(pairs, width, ["cls", "group"], ("own_band", "band")).drop("n")


def in_chunks(pairs: DataFrame) -> DataFrame:
    """`pairs` (cls, group) with `chunk`: a group that many sets ask meets them in chunks, each in a row of its own."""
    counts = pairs.groupBy("group").agg(F.ceil(F.count("*") / SETS_PER_CHUNK).alias("chunks"))
    return pairs.join(counts, "group").select(
        "cls", "group", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk")
    )


def with_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """`rows` (id, n, cls, ...) with the columns of `results` (cls, copies, ...), which has a row per class.

    The copies of a class with more than ROWS_PER_SLICE rows are spread over slices by their ids. There is
    at most one such class per ROWS_PER_SLICE rows, so the list of them is small enough to be broadcast.
    """
    slices = F.ceil(F.col("copies") / ROWS_PER_SLICE).cast("int")
    hot = F.broadcast(results.filter(F.col("copies") > ROWS_PER_SLICE).select("cls", slices.alias("slices")))
    spread = F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("slices")))
    left = rows.join(hot, "cls", "left").withColumn("slice", spread.cast("int")).drop("slices")
    every = F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1))
    return left.join(results.withColumn("slice", every).drop("copies"), ["cls", "slice"], "left")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, per_cent: int = 90
) -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id and set_id.

    A text's set holds its distinct shingles of `size` words, A-Z as a-z; of fewer words, the whole
    sequence. Two sets link when 100 * intersection >= per_cent * union. component_id is the
    smallest id reachable by links.

    1. Equal sets are one class; all else works on classes. Classes with the same smallest token
       and about the same size make a group, cut by the classes' address where it is large.
    2. The matrix has a cell per group and token that comes first in one of its sets. Bit tables of
       fixed size spare tokens that no other set has among its first.
    3. Links with hubs are found first (`through_hubs`), and the sets of a component found so make groups
       of their own: a cluster of n similar sets costs no pairs of its groups.
    4. Sets with enough cells in common with a group's union, and sizes that allow a link, are candidates, if
       they aren't of one component yet. They and the group are read once more; a bit table spares the others.
       A group meets the sets that ask it in one row, or in chunks of them, where its union bounds
       the overlap with each before its sets are compared, exactly. Groups of several components also meet themselves.
    5. Spanning links of each meeting, and the components of hubs, give the components.

    Texts without words, missing ones included, have no shingles and are alone. A missing id is
    passed over by the minimum; a component without ids has none. Repeated rows are one class. Texts of any
    length are whole; the sets of a group and a chunk, or a long text's one set, have to fit into a task. An
    empty table gives an empty one; further columns are not read. Tables written on the way are deleted
    once they have been read.
    """
    spark = docs.sparkSession
    whole = frames.whole(F.col(text_col)).alias("text")
    texts = docs.select(whole)
    rows = frames.staged(addressed(docs.select(F.col(id_col).alias("id"), whole), size), "sets")
    width = float(np.log(100 / per_cent) * 1.0001) if per_cent < 100 else 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / width).alias("band")
    per_class = rows.filter("n > 0").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("low").alias("low"), F.min("id").alias("min_id"), F.count("*").alias("copies")
    )
    classes = frames.staged(per_class.select("*", band, F.monotonically_increasing_id().alias("number")), "classes")

    demoted = demotions(texts, size, per_cent)
    frames.forget_shuffles(spark)
    first = frames.staged(firsts(texts, size, per_cent, demoted), "firsts")
    counts = first.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = frames.staged(only_held(first, bit_table(counts.filter("n > 1").select("token"))), "found")
    frames.dropped(first)
    frames.forget_shuffles(spark)

    grouped = in_groups(classes.withColumn("root", F.lit(None).cast("binary")))
    known = frames.staged(through_hubs(texts, found, grouped, size, per_cent, width), "hub-components")
    grouped = in_groups(classes.join(known.withColumnRenamed("node", "cls"), "cls", "left"))
    matrix = frames.staged(with_cells(found, grouped, per_cent).distinct(), "matrix")
    cells = frames.staged(between_owners(matrix), "cells")
    frames.dropped(found, matrix)
    frames.forget_shuffles(spark)
    pairs = frames.staged(in_chunks(candidates(cells, width)), "pairs")
    frames.dropped(cells)
    frames.forget_shuffles(spark)

    owner = F.coalesce("comp", F.xxhash64("cls"))
    inner = grouped.groupBy("group").agg(F.min(owner).alias("least"), F.max(owner).alias("most")).filter("least != most")
    asked = pairs.select("group", "chunk").distinct().withColumn("side", F.lit(1))
    alone = inner.select("group", F.lit(-1).alias("chunk"), F.lit(0).alias("side"))
    asked = frames.staged(asked.union(alone), "asked")
    asking = pairs.withColumn("side", F.lit(0))
    members = grouped.select("cls", "group").join(asked, "group").select("cls", "group", "chunk", "side")
    meeting = frames.staged(asking.union(members), "meeting")
    sets = opened_sets(texts, size, meeting.select("cls").distinct()).join(meeting, "cls")
    links = met(sets, ["group", "chunk"], per_cent)
    frames.dropped(pairs, asked, meeting)
    frames.forget_shuffles(spark)

    forest = components(links.union(known.select("node", "root")))
    named = classes.join(forest.withColumnRenamed("node", "cls"), "cls")
    smallest = named.groupBy("root").agg(F.min("min_id").alias("component"))
    placed = named.select("cls", "root").join(smallest, "root").select("cls", "component")
    results = classes.join(placed, "cls", "left").select(
        "cls", "copies", F.coalesce("component", "min_id").alias("component_id")
    )
    results = frames.staged(results, "class-results")
    return with_results(rows, results).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.lower(F.hex("cls")).alias("set_id"),
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The rows of `docs` but for near duplicates, with the columns of `docs`.

    Of each component one row stays: one with the smallest id, and of several such rows the first
    by number. Rows without words are no duplicates of anything and all stay. Rows have a
    number (`frames.as_rows`) and are decided on without their texts. A bitmap of fixed size tells
    which rows may have to go: only their texts are shuffled. Missing ids come after all others;
    an empty table gives an empty one; columns may bear any name.
    """
    rows = frames.as_rows(docs, "dedup-docs")
    row_id = F.col(f"row.`{id_col}`")
    place = F.struct(row_id.isNull().alias("missing"), row_id.alias("id"), "marker").alias("place")
    found = similar_groups(rows.select(place, F.col(f"row.`{text_col}`").alias("text")), "place", "text", **rule)
    go = found.filter(F.col("place") != F.col("component_id")).select(F.col("place.marker").alias("marker"))
    go = frames.staged(go, "dedup-go")
    asked = frames.with_possible(rows, frames.slot_bitmaps(go), "marker")
    stay = asked.filter("NOT possible").select("row.*")
    return stay.union(asked.filter("possible").join(go, "marker", "left_anti").select("row.*"))


def addressed(rows: DataFrame, size: int) -> DataFrame:
    """id, n, cls (the set's address, null if empty) and low (its smallest token) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles.shingle_set(w, size) for w in shingles.texts_words(batch.column(1)))
            made = [(len(s), set_address(s), int(s[0].view(np.int64))) if len(s) else (0, None, None) for s in sets]
            n, cls, low = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(low, pa.int64())],
                ["id", "n", "cls", "low"],
            )

    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("low", T.LongType())])
    return rows.mapInArrow(run, schema)
