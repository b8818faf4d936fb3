"""Token counts under byte-pair merges, without making the tokens."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Counts kept per worker; the table is emptied when it is full.
CACHED_PIECES = 300_000
#: Texts above so many characters are split into pieces a few at a time.
LONG_TEXT = 2_000_000
#: How the byte-level pre-tokenizer splits text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_symbols() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte.

    Printable bytes stand for themselves, the others for code points from 256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Counts the tokens of texts under the merges of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"])
        self.ranks = {(left, right): rank for rank, (left, right) in enumerate(pairs)}
        self.symbols = byte_symbols()
        specials = sorted((t["content"] for t in read["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.cache: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges. A heap holds the adjacent pairs that have a rank.

        Symbols form a linked list. A pair taken from the heap is stale if either side has
        changed since; of equal ranks the leftmost goes first.
        """
        parts: list[str | None] = [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        count = len(parts)
        before = list(range(-1, count - 1))
        after = [*range(1, count), -1]
        ranks = self.ranks
        heap = [
            (rank, at, pair)
            for at, pair in enumerate(zip(parts, parts[1:], strict=False))
            if (rank := ranks.get(pair)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, at, (left, right) = heapq.heappop(heap)
            then = after[at]
            if parts[at] != left or then < 0 or parts[then] != right:
                continue
            parts[at] = joined = left + right
            parts[then] = None
            count -= 1
            after[at] = beyond = after[then]
            if beyond >= 0:
                before[beyond] = at
                if (rank := ranks.get((joined, parts[beyond]))) is not None:
                    heapq.heappush(heap, (rank, at, (joined, parts[beyond])))
            if (ahead := before[at]) >= 0 and (rank := ranks.get((parts[ahead], joined))) is not None:
                heapq.heappush(heap, (rank, ahead, (parts[ahead], joined)))
        return count

    def of_pieces(self, pieces: Counter) -> int:
        total, cache = 0, self.cache
        for piece, times in pieces.items():
            count = cache.get(piece)
            if count is None:
                count = self.merged(piece)
                if len(cache) >= CACHED_PIECES:
                    cache.clear()
                if len(piece) <= 64:
                    cache[piece] = count
            total += count * times
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string is one token, as the library has it."""
        total = 0
        if self.special and (found := self.special.findall(text)):
            total, parts = len(found), self.special.split(text)
        else:
            parts = [text]
        for part in parts:
            if len(part) <= LONG_TEXT:
                total += self.of_pieces(Counter(PIECE.findall(part)))
            else:
                pieces = (m.group() for m in PIECE.finditer(part))
                while some := Counter(islice(pieces, 100_000)):
                    total += self.of_pieces(some)
        return total


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """Read once per worker."""
    return Merges(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of vocabularies has a file; every executor has that package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
) -> DataFrame:
    """Per row of `docs`: its id, n_bytes (UTF-8), n_tokens, over_limit.

    Whole texts are counted, in one pass without a shuffle. `tokenizer` names a byte-level BPE file
    of the vocabularies' package. Missing and empty texts have no tokens; ids may be missing or
    repeat; an empty table gives an empty one; further columns are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merges(tokenizer_path(tokenizer))
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")
    )
    schema = T.StructType(
        [read.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return read.mapInArrow(counted, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
