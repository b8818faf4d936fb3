"""The n-gram join against comparing all sets that share a shingle."""

from __future__ import annotations

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assetlens.llm import components, frames, ngram_join, shingles

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def check(docs, size, per_cent):
    rows = docs.select("doc_id", "text").collect()
    classes = defaultdict(list)
    for r in rows:
        classes[shingle_set(r.text, size)].append(r.doc_id)
    classes.pop(frozenset(), None)
    sets, index, links = list(classes), defaultdict(list), []
    for at, tokens in enumerate(sets):
        for other, common in Counter(k for t in tokens for k in index[t]).items():
            if 100 * common >= per_cent * (len(tokens) + len(sets[other]) - common):
                links.append((at, other))
        for t in tokens:
            index[t].append(at)
    root = roots(range(len(sets)), links)
    least = defaultdict(list)
    for at, tokens in enumerate(sets):
        least[root[at]] += [i for i in classes[tokens] if i is not None]
    number = {tokens: at for at, tokens in enumerate(sets)}
    want = Counter()
    for r in rows:
        tokens = shingle_set(r.text, size)
        if tokens:
            at = number[tokens]
            want[(r.doc_id, len(tokens), min(least[root[at]], default=None))] += 1
        else:
            want[(r.doc_id, 0, r.doc_id)] += 1
    found = ngram_join.similar_groups(docs, size=size, per_cent=per_cent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    return len(links)


def copies(seed, n):
    """Texts with near copies of a few, a shared passage, and short ones."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [draw.choices(words, k=draw.choice([5, 12, 30, 60])) for _ in range(6)]
    passage = draw.choices(words, k=25)
    for at in range(n):
        text = list(draw.choice(bases)) if draw.random() < 0.7 else draw.choices(words, k=20) + passage
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(len(text))] = draw.choice(words)
        yield at, " ".join(text)


@pytest.mark.parametrize(("size", "per_cent"), [(3, 90), (5, 80), (2, 60), (1, 100)])
def test_copies(spark, size, per_cent, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 200)
    monkeypatch.setattr(ngram_join, "ROWS_PER_SLICE", 3)
    monkeypatch.setattr(ngram_join, "SETS_PER_CHUNK", 4)
    monkeypatch.setattr(ngram_join, "HUBS_PER_GROUP", 1)
    docs = spark.createDataFrame(list(copies(size, 250)), "doc_id bigint, text string")
    assert check(docs, size, per_cent) > 0 or per_cent == 100


@pytest.mark.parametrize(("size", "per_cent"), [(3, 90), (5, 80)])
def test_tables(spark, medium, size, per_cent):
    assert check(spark.read.parquet(f"{medium}/documents.parquet"), size, per_cent) > 0


def test_demotion_is_a_hint(spark, monkeypatch):
    """Whatever tokens are demoted, the links are the same."""
    docs = spark.createDataFrame(list(copies(7, 200)), "doc_id bigint, text string")
    for few, looked_at in ((0, 1), (1, 50), (10**9, 2)):
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "LOOKED_AT", looked_at)
        assert check(docs, 3, 80) > 0


def test_levels(spark):
    """A token's level is the logarithm of how many sets have it among their first."""
    texts = [("a b",)] * 3 + [(f"a b {k}",) for k in range(40)]
    docs = spark.createDataFrame(texts, "text string")
    demoted = ngram_join.demotions(docs, 1, 50)
    sets = [shingles.shingle_set(w, 1) for w in shingles.texts_words(pa.array([t for t, in texts]))]
    looked_at = [s[: int(ngram_join.LOOKED_AT * ngram_join.first_count(len(s), 50))] for s in sets[2:]]
    counts = Counter(int(t) for s in looked_at for t in s)
    for token, n in counts.items():
        if n >= 40:
            assert demoted[token >> 40] == 5
    assert max(counts.values()) >= 40 and demoted.astype(bool).sum() == sum(n > ngram_join.FEW for n in counts.values())


def test_tables_are_deleted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(list(copies(3, 100)), "doc_id bigint, text string")
    monkeypatch.setattr(frames, "shared_folder", lambda spark: str(tmp_path))
    assert ngram_join.similar_groups(docs).count() == 100
    left = {path.name.rsplit("-", 1)[0] for path in tmp_path.iterdir()}
    assert "sets" in left
    assert not left & {"firsts", "found", "matrix", "pairs", "asked", "meeting", "hubs", "hub-ends", "hub-sets"}


def test_awkward(awkward, nothing):
    check(awkward, 3, 90)
    assert ngram_join.similar_groups(nothing).count() == 0


def test_components(spark):
    draw = random.Random(3)
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in range(101, 180)]
    other = [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(70)]
    edges = chain + star + other
    draw.shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    root = roots(nodes, [e for e in edges if e[0] != e[1]])
    least = {r: min(n for n in nodes if root[n] == r) for r in root.values()}
    assert {(r.node, r.root) for r in found} == {(n, least[root[n]]) for n in nodes} and len(found) == len(nodes)


def test_word_hashes(monkeypatch):
    texts = ["Hello  wORLD\n", "", " a", "a", "\x0b\t", "é É ünï", "x" * 50 + " y", "hello world hello", "b "]

    def plain(word):
        raw = [b + 32 if 65 <= b <= 90 else b for b in word.encode()]
        total = sum((b + 1) * pow(int(shingles.BYTE_BASE), i, 2**64) for i, b in enumerate(raw)) + len(raw)
        return int(shingles.mixed(np.array([total % 2**64], dtype=np.uint64))[0])

    want = [[plain(w) for w in re.findall("[^\x20\x09-\x0d]+", t)] for t in texts]
    for text_bytes, hash_bytes in ((1 << 20, 1 << 20), (5, 3)):
        monkeypatch.setattr(shingles, "TEXT_BYTES", text_bytes)
        monkeypatch.setattr(shingles, "HASH_BYTES", hash_bytes)
        for skip in (0, 3):
            got = [list(map(int, w)) for w in shingles.texts_words(pa.array(texts)[skip:])]
            assert got == want[skip:]


def changed_copies(n, of=200, changes=12):
    """Copies of one text, each changed in so many places that few link, and the text itself."""
    draw = random.Random(5)
    base = [f"w{k}" for k in range(of)]
    yield 0, " ".join(base)
    for at in range(1, n):
        text = list(base)
        for place in draw.sample(range(of), changes if at % 4 else 1):
            text[place] = f"new{at}-{place}"
        yield at, " ".join(text)


def test_cluster_of_changed_copies(spark, monkeypatch):
    """Of a cluster whose sets share nearly all tokens, those too far from each other aren't candidates."""
    docs = spark.createDataFrame(list(changed_copies(160)), "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 800)
    seen = []
    candidates = ngram_join.candidates

    def counted(*args):
        pairs = candidates(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_join, "candidates", counted)
    assert check(docs, 3, 90) > 0
    assert seen == [0]


def test_frequent_tokens_of_clusters_are_demoted(spark):
    """Also those that aren't among the first of any set by hash."""
    docs = spark.createDataFrame(list(changed_copies(60)), "doc_id bigint, text string").coalesce(1)
    demoted = ngram_join.demotions(docs.select("text"), 3, 90)
    (words,) = shingles.texts_words(pa.array([docs.first().text]))
    assert demoted[shingles.shingle_set(words, 3) >> np.uint64(40)].all()


def test_cells_of_one_owner_are_left_out(spark):
    """Tokens of one component, or of one group of none, make no candidates."""
    at = [(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 3, None), (3, 3, None), (3, 3, None), (4, 3, None), (4, 4, None)]
    rows = [(bytes([k]), 10, group, 1, comp, token, 10) for k, (token, group, comp) in enumerate(at)]
    cells = spark.createDataFrame(rows, "cls binary, n bigint, group bigint, band bigint, comp bigint, token bigint, reach bigint")
    left = ngram_join.between_owners(cells)
    assert left.columns == cells.columns and sorted(r.token for r in left.collect()) == [2, 2, 4, 4]
    found = [sorted(map(tuple, ngram_join.candidates(some, 0.1).collect())) for some in (cells, left)]
    assert found[0] == found[1] and len(found[0]) == 2
