"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm import frames
from assetlens.llm.token_counts import tokenizer_path

MODEL = "piece_bpe_32k.model"
#: How a vocabulary writes a space.
SPACE = "▁"
#: Words of so many characters at most are learned, so many at a time.
LEARNED_CHARS = 32
LEARNED_TOGETHER = 4096
#: When so many learned words are held, those not asked for since half as many came are let go.
HELD_WORDS = 400_000
#: Texts are taken together up to so many characters.
TOGETHER_CHARS = 4 << 20


def byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that is part of no character."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("assetlens-byte-by-byte", byte_by_byte)


class Words(dict):
    """Ids of words. Ones that were not learned go through an agenda of their own, and aren't kept."""

    def __init__(self, merged: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.merged = merged
        self.new: list[tuple[str, tuple[int, ...]]] = []

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.merged(word)
        self.new.append((word, ids))
        return ids


class Agendas:
    """The agendas of many words at a time: a row per word, whose cells hold the ranks of its adjacent pairs.

    Each round takes the best pair of every row that has one, and enters the ranks of the two pairs
    that the joined symbol makes. Pieces need different scores, so that ranks are unique.
    """

    def __init__(self, pieces: dict[str, tuple[float, int]]) -> None:
        ranked = sorted((piece for piece in pieces if len(piece) > 1), key=pieces.__getitem__)
        self.none = np.int32(len(ranked))
        self.ids = np.array([*(pieces[piece][1] for piece in ranked), -1], dtype=np.int32)
        halves = [
            (left[1] << 32 | right[1], rank)
            for rank, piece in enumerate(ranked)
            for cut in range(1, len(piece))
            if (left := pieces.get(piece[:cut])) and (right := pieces.get(piece[cut:]))
        ]
        halves.sort()
        self.keys, self.ranks = (np.array(column) for column in zip(*halves, strict=True))
        self.ranks = self.ranks.astype(np.int32)
        self.symbols = np.full(0x110000, -1, dtype=np.int32)
        for piece, (_, number) in pieces.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = number

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of symbols makes; of pairs that make none, `none`."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merged(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """Ids of each word, None where one has a character that is no piece."""
        count, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        flat = self.symbols[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        width, row = int(sizes.max()), np.repeat(np.arange(count), sizes)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Two cells beyond the last: the end of a row, and what stands before its start.
        symbols = np.full((count, width + 2), -1, dtype=np.int32)
        symbols[row, column] = flat
        agenda = np.full((count, width + 2), self.none, dtype=np.int32)
        inner = np.flatnonzero(column[1:])
        agenda[row[inner], column[inner]] = self.pairs(flat[inner], flat[inner + 1])
        after = np.tile(np.arange(1, width + 3, dtype=np.int32), (count, 1))
        after[np.arange(count), sizes - 1] = width
        before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (count, 1))
        before[:, 0] = width + 1
        foreign = np.zeros(count, dtype=bool)
        foreign[row[flat < 0]] = True
        rows = np.flatnonzero(~foreign)
        while len(rows):
            at = agenda[rows].argmin(axis=1)
            best = agenda[rows, at]
            some = best < self.none
            rows, at, best = rows[some], at[some], best[some]
            then = after[rows, at]
            beyond, ahead, joined = after[rows, then], before[rows, at], self.ids[best]
            symbols[rows, at], symbols[rows, then], agenda[rows, then] = joined, -1, self.none
            after[rows, at], before[rows, beyond] = beyond, at
            agenda[rows, at] = self.pairs(joined, symbols[rows, beyond])
            agenda[rows, ahead] = self.pairs(symbols[rows, ahead], joined)
        left = symbols[:, :width] >= 0
        ends, ids = np.cumsum(left.sum(axis=1)).tolist(), symbols[:, :width][left].tolist()
        found = [tuple(ids[begin:end]) for begin, end in zip([0, *ends], ends, strict=False)]
        return [None if other else some for other, some in zip(foreign.tolist(), found, strict=True)]


class Codec:
    """Encodes and decodes under one merge-type model file with byte fallback.

    Only what the file's kind needs is here: text is taken as it is (no normalisation table), spaces
    are written as a mark, and one such mark stands before a text. Other models raise ValueError.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        normalizer, trainer = spec.normalizer_spec, spec.trainer_spec
        kinds = {piece.type for piece in spec.pieces}
        if (
            trainer.model_type != trainer.BPE
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or normalizer.precompiled_charsmap
            or normalizer.remove_extra_whitespaces
            or not normalizer.escape_whitespaces
            or not normalizer.add_dummy_prefix
            or kinds & {spec.SentencePiece.USER_DEFINED, spec.SentencePiece.UNUSED}
        ):
            raise ValueError(f"{path}: no plain merge-type model with byte fallback")
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids = [0] * 256
        self.written: list[bytes] = []
        for number, piece in enumerate(spec.pieces):
            if piece.type == spec.SentencePiece.NORMAL:
                self.pieces[piece.piece] = (-piece.score, number)
                self.written.append(piece.piece.replace(SPACE, " ").encode())
            elif piece.type == spec.SentencePiece.BYTE:
                value = int(piece.piece[1:-1], 16)
                self.byte_ids[value] = number
                self.written.append(bytes([value]))
            elif piece.type == spec.SentencePiece.UNKNOWN:
                self.written.append(trainer.unk_surface.encode())
            else:
                self.written.append(b"")
        # A space mark that follows another character begins a word, if no piece has it inside; a line
        # feed is a word, if it is in no piece: nothing is ever merged across.
        inside = any(SPACE in piece.lstrip(SPACE) for piece in self.pieces)
        self.lone = "" if any("\n" in piece for piece in self.pieces) else "\n"
        between = f"[^{SPACE}{self.lone}]"
        apart = f"{SPACE}+{between}*|{between}+" + ("|\n" if self.lone else "")
        self.words = re.compile(".+" if inside else apart, re.DOTALL)
        self.known, self.older = Words(self.merged), Words(self.merged)
        # Only runs of marks share scores in the models at hand; equal scores need the one agenda's order.
        scores = [score for piece, (score, _) in self.pieces.items() if piece.strip(SPACE) and len(piece) > 1]
        self.agendas = Agendas(self.pieces) if not inside and len(scores) == len(set(scores)) else None
        self.plain = {number for _, number in self.pieces.values()}
        self.silent = {number for number, written in enumerate(self.written) if not written}
        self.decimal = [str(number) for number in range(len(self.written))]

    def merged(self, word: str) -> tuple[int, ...]:
        """Ids of a word. The agenda holds the adjacent pairs of symbols that are a piece together.

        The pair with the best score goes first, of equal ones the leftmost. Symbols form a linked
        list; an entry is stale if its symbols have become others since, which their joint length
        tells. Symbols that end up as no piece are written as their bytes.
        """
        parts: list[str] = list(word)
        count = len(parts)
        before = list(range(-1, count - 1))
        after = [*range(1, count), -1]
        pieces = self.pieces
        agenda = [
            (found[0], at, 2)
            for at in range(count - 1)
            if (found := pieces.get(parts[at] + parts[at + 1])) is not None
        ]
        heapq.heapify(agenda)
        while agenda:
            _, at, size = heapq.heappop(agenda)
            left, then = parts[at], after[at]
            if not left or then < 0 or len(left) + len(parts[then]) != size:
                continue
            joined = parts[at] = left + parts[then]
            parts[then] = ""
            beyond = after[at] = after[then]
            if beyond >= 0:
                before[beyond] = at
                if (found := pieces.get(joined + parts[beyond])) is not None:
                    heapq.heappush(agenda, (found[0], at, size + len(parts[beyond])))
            ahead = before[at]
            if ahead >= 0 and (found := pieces.get(parts[ahead] + joined)) is not None:
                heapq.heappush(agenda, (found[0], ahead, len(parts[ahead]) + size))
        ids: list[int] = []
        for part in filter(None, parts):
            found = pieces.get(part)
            if found is None:
                ids += [self.byte_ids[b] for b in part.encode()]
            else:
                ids.append(found[1])
        return tuple(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text, spaces as marks and one more before it. An empty text has none."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        """Merge the words that aren't known, many at a time where they are short and plain."""
        if len(self.known) >= HELD_WORDS // 2:
            self.known.new, kept = [], self.known.new
            self.older, self.known = self.known, Words(self.merged)
            self.known.new = kept
        asked = [word for word in words if word not in self.known and len(word) <= LEARNED_CHARS]
        new = [word for word in asked if word not in self.older] if self.older else asked
        if len(new) < len(asked):
            self.known.update((word, self.older[word]) for word in asked if word in self.older)
        # By length, so that words merged together have rows of about one width and end in about as many rounds.
        plain = sorted((word for word in new if word.rfind(SPACE) < 1), key=len) if self.agendas else []
        for begin in range(0, len(plain), LEARNED_TOGETHER):
            some = plain[begin : begin + LEARNED_TOGETHER]
            self.known.update(zip(some, self.agendas.merged(some), strict=True))
        for word in new if len(plain) < len(new) else plain:
            if self.known.get(word) is None:
                self.known[word] = self.merged(word)
        self.known.new += zip(new, map(self.known.__getitem__, new), strict=True)

    def of_words(self, words: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without begin or end; an empty one has none."""
        words = self.split(text)
        self.learn(set(words))
        return self.of_words(words)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. The mark before the text is taken away; bytes that are no character are replaced."""
        runs = [ids]
        if not self.silent.isdisjoint(ids):
            runs = [list(run) for silent, run in groupby(ids, self.silent.__contains__) if not silent]
        text = "".join(
            b"".join(map(self.written.__getitem__, run)).decode("utf-8", "assetlens-byte-by-byte") for run in runs
        )
        begins_plain = bool(runs) and bool(runs[0]) and runs[0][0] in self.plain
        return text[1:] if begins_plain and text.startswith(" ") else text

    def differences(self) -> list[str]:
        """Words merged since the last call for which the library has other ids, or decodes them otherwise."""
        # The library puts a mark before a text, as most words have; others are asked for after a lone
        # character. Of a lone mark it would see an empty text, which has no ids.
        some, self.known.new = [pair for pair in self.known.new if pair[0] != SPACE], []
        before = self.merged(SPACE) + self.merged("\n")
        asked = [word[1:].replace(SPACE, " ") if word[0] == SPACE else "\n" + word for word, _ in some]
        own = [ids if word[0] == SPACE else before + ids for word, ids in some]
        expected = self.library.encode(asked, num_threads=1)
        together = list(chain.from_iterable(own))
        wrong: list[str] = []
        if list(map(len, own)) != list(map(len, expected)) or together != list(chain.from_iterable(expected)):
            wrong = [word for (word, _), ids, theirs in zip(some, own, expected, strict=True) if list(ids) != theirs]
        elif self.library.decode(together) != self.decode(together):
            wrong = [word for word, ids in some if self.library.decode(list(ids)) != self.decode(ids)]
        return wrong


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Read once per worker."""
    return Codec(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def together(column: pa.Array) -> Iterator[list[str]]:
    """Texts, so many at a time that they have TOGETHER_CHARS characters, or one longer text."""
    some, size = [], 0
    for scalar in column:
        text = scalar.as_py()
        if some and size + len(text) > TOGETHER_CHARS:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def piece_ids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    digests: bool = False,
    whole_check: bool = False,
) -> DataFrame:
    """Per row of `docs`: its id, n_tokens, and ids and decoded, or with `digests` the SHA-256 of both.

    `ids` are those of the whole text under the merge-type `model`, without begin or end; `decoded`
    is the text made of them again. ids_sha256 is of the decimal ids joined by commas, decoded_sha256
    of the decoded text in UTF-8. In each Arrow batch the library encodes and decodes every word
    that went through the agenda, with `whole_check` every whole text; if it has anything else, the job
    fails. One pass, no shuffle; a task holds a batch of rows. Ids of short words seen lately are kept.

    Missing and empty texts have no ids and decode to an empty text. A text's space marks (U+2581) decode
    to spaces, as in the library. Texts without spaces run through one agenda as a whole. Ids of
    rows may be missing or repeat; repeated rows give repeated results. An empty table gives an empty
    one; further columns are not read.
    """
    kept = pa.string() if digests else pa.list_(pa.int32())
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(model))
        for batch in batches:
            n_tokens, ids_out, decoded_out = [], [], []
            for texts in together(batch.column(1)):
                split = [own.split(text) for text in texts]
                own.learn(set(chain.from_iterable(split)))
                for text, words in zip(texts, split, strict=True):
                    ids = own.of_words(words)
                    decoded = own.decode(ids)
                    if whole_check:
                        expected = own.library.encode(text, num_threads=1)
                        if ids != expected or decoded != own.library.decode(expected):
                            raise ValueError(f"the library has other ids for {text[:80]!r}")
                    n_tokens.append(len(ids))
                    ids_out.append(sha256(",".join(map(own.decimal.__getitem__, ids))) if digests else ids)
                    decoded_out.append(sha256(decoded) if digests else decoded)
                if wrong := own.differences():
                    raise ValueError(f"the library has other ids for {wrong[0][:80]!r}")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(ids_out, kept),
                    pa.array(decoded_out, pa.string()),
                ],
                ["id", "n_tokens", *names],
            )

    read = docs.select(F.col(id_col).alias("id"), frames.whole(F.col(text_col)).alias("text"))
    schema = T.StructType(
        [
            read.schema["id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField(names[0], T.StringType() if digests else T.ArrayType(T.IntegerType())),
            T.StructField(names[1], T.StringType()),
        ]
    )
    return read.mapInArrow(coded, schema).withColumnRenamed("id", id_col)
