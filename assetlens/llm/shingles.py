"""Words and word windows of texts as 64-bit Karp-Rabin fingerprints, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the rolling hashes over bytes and over words.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Texts are taken together up to so many bytes; words are hashed so many bytes at a time.
TEXT_BYTES = 4 << 20
HASH_BYTES = 1 << 20

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits only, with all bytes beyond ASCII: words without their punctuation.
IS_LETTER = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z) of the texts `data[offsets[i]:offsets[i + 1]]`, and where each
    text's words start among them. Words are runs of bytes of the `kind`, by default of those other than space and \\t to \\r."""
    word = kind[data]
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    edge[inner] = word[inner]
    starts = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    edge[last] = word[last]
    ends = np.flatnonzero(edge) + 1
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        begin, sizes = starts[at], (ends - starts)[at:stop]
        own = LOWERED[data[begin : ends[stop - 1]]].astype(np.uint64) + np.uint64(1)
        where = np.zeros(len(own), dtype=np.int64)
        where[starts[at:stop] - begin] = starts[at:stop] - begin
        place = np.arange(len(own)) - np.maximum.accumulate(where)
        factors = powers(BYTE_BASE, int(place.max()) + 1)
        own *= factors[place]
        own[~word[begin : ends[stop - 1]]] = 0
        out[at:stop] = np.add.reduceat(own, starts[at:stop] - begin) + sizes.astype(np.uint64)
        at = stop
    return mixed(out), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; the hash runs on by one word at a time."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    factors = powers(WORD_BASE, size)
    total = np.zeros(n, dtype=np.uint64)
    for at in range(size):
        total += words[at : at + n] * factors[at]
    return mixed(total + np.uint64(size))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles in order; of fewer words the whole sequence is one; of none, none."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(words, min(size, len(words))))


def texts_words(column: pa.Array, kind: np.ndarray = IS_WORD) -> Iterator[np.ndarray]:
    """The word hashes of each text of an Arrow column of strings without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32).astype(np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXT_BYTES, "right")) - 1)
        begin = offsets[at]
        hashes, first = word_hashes(data[begin : offsets[stop]], offsets[at : stop + 1] - begin, kind)
        for text in range(stop - at):
            yield hashes[first[text] : first[text + 1]]
        at = stop
