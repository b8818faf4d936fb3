"""Decontamination, quality and the whole pipeline against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import regex

from assetlens.llm import decontaminate, ngram_join, quality, queries, shingles


def words_of(text):
    """Runs of letters and digits, A-Z lower-cased; marks and symbols of all scripts separate them."""
    text = regex.sub(decontaminate.MARKS, " ", text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_tiles(text, item, least=5):
    """Greedy tiling by looking for the longest unmarked match each time."""
    marked_text, marked_item, found = set(), set(), []
    known = defaultdict(list)
    for here, word in enumerate(text):
        known[word].append(here)
    while True:
        best = (0, 0, 0)
        for there in range(len(item)):
            for here in known[item[there]]:
                size = 0
                while (
                    there + size < len(item) and here + size < len(text) and item[there + size] == text[here + size]
                    and there + size not in marked_item and here + size not in marked_text
                ):
                    size += 1
                if size > best[0]:
                    best = (size, here, there)
        size, here, there = best
        if size < least:
            return found
        found.append(best)
        marked_text.update(range(here, here + size))
        marked_item.update(range(there, there + size))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_tiles(least):
    draw = random.Random(2)
    for _ in range(150):
        item = draw.choices(range(4 if draw.random() < 0.3 else 40), k=draw.randint(least, 25))
        text = draw.choices(range(40), k=10)
        for _ in range(draw.randint(0, 4)):
            start = draw.randrange(len(item))
            text += item[start : start + draw.randint(3, 20)] + draw.choices(range(40), k=draw.randint(0, 3))
        hashes = [shingles.windows(np.array(x, dtype=np.uint64) + np.uint64(9), least).view(np.int64) for x in (text, item)]
        places = np.flatnonzero(np.isin(hashes[0], hashes[1]))
        assert decontaminate.tiles(places, hashes[0][places], hashes[1], least) == plain_tiles(text, item, least)


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(4)
    vocabulary = [f"wörd{k}" if k % 9 == 0 else f"word{k}" for k in range(3000)]
    items = [draw.choices(vocabulary, k=k) for k in (30, 40, 12, 4)]
    clean = [draw.choices(vocabulary, k=60) for _ in range(20)]
    first = items[0]
    docs = [
        (100, clean[0] + first + clean[1]),
        (101, clean[2] + first[20:] + clean[3] + first[:10] + first[10:20]),
        (102, clean[4] + first[:10] + clean[5]),
        (103, [w.upper() + "," if w.isascii() else w + "!" for w in items[1]]),
        (104, items[3] + clean[6]),
        (105, items[2] * 3),
    ]
    rows = [(k, " ".join(words)) for k, words in [*docs, *enumerate(clean)]]
    tests = [(k, " ".join(words)) for k, words in enumerate(items)]
    return spark.createDataFrame([*rows, rows[0], (None, rows[0][1]), (7, None)], "doc_id bigint, text string"), spark.createDataFrame([*tests, (9, tests[0][1]), (8, None), (None, "")], "item_id bigint, text string")


def plain_leaks(docs, items, least=decontaminate.TILE_WORDS, coverage=decontaminate.COVERAGE):
    """(doc_id, item_id, item_words, covered_words) by tiling every item that has a tile's words in common."""
    items = [(i, words) for i, words in ((i, words_of(text)) for i, text in items) if words]
    out = Counter()
    for doc_id, text in docs:
        words = words_of(text)
        for item, own in items:
            tile = min(least, len(own))
            grams = {tuple(words[i : i + tile]) for i in range(len(words) - tile + 1)}
            if any(tuple(own[i : i + tile]) in grams for i in range(len(own) - tile + 1)):
                covered = sum(t[0] for t in plain_tiles(words, own, tile))
                if covered >= coverage * len(own):
                    out[doc_id, item, len(own), covered] += 1
    return out


def leak_rows(docs, tests):
    return Counter((r.doc_id, r.item_id, r.item_words, r.covered_words) for r in decontaminate.leaks(docs, tests).collect())


def pairs_of(df, key):
    return [(r[key], r.text) for r in df.collect()]


def test_planted_leaks(planted):
    docs, tests = planted
    found = leak_rows(docs, tests)
    assert found == plain_leaks(pairs_of(docs, "doc_id"), pairs_of(tests, "item_id"))
    pairs = Counter()
    for (doc, item, _, _), n in found.items():
        pairs[doc, item] += n
    assert pairs == {(100, 0): 2, (100, 9): 2, (None, 0): 1, (None, 9): 1, (101, 0): 1, (101, 9): 1, (103, 1): 1, (104, 3): 1, (105, 2): 1}
    kept = decontaminate.without_leaks(docs, tests)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(20), 7, 102])


def test_query_against_plain(spark, small):
    docs, tests = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_leaks(pairs_of(docs, "doc_id"), pairs_of(tests, "item_id"))
    rows = queries.op2_tiled_leaks(spark, small).collect()
    assert want and Counter((r.doc_id, r.item_id, r.item_words, r.covered_words) for r in rows) == want


def test_every_fourth_word_changed(spark):
    """The rule is one, whatever an item's length."""
    words = {n: [f"item{n}w{k}" for k in range(n)] for n in (12, 24, 25, 48, 100)}
    texts = [(n, " ".join("changed" if k % 4 == 3 else w for k, w in enumerate(item))) for n, item in words.items()]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    tests = spark.createDataFrame([(n, " ".join(item)) for n, item in words.items()], "item_id bigint, text string")
    found = decontaminate.leaks(docs, tests, coverage=0.7).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(n, n) for n in words}


def test_edited_leaks(spark):
    """One changed word anywhere in an item, and punctuation of all scripts, hide nothing."""
    words = {n: [f"item{n}w{k}" for k in range(n)] for n in (15, 20, 24, 25, 40)}
    edited = [" ".join(["before", *item[:at], "changed", *item[at + 1 :], "after"]) for item in words.values() for at in range(len(item))]
    marked = ["\u201c" + "\u201d\u2014".join(item) + "\u2026" for item in words.values()]
    docs = spark.createDataFrame(list(enumerate(edited + marked)), "doc_id bigint, text string")
    tests = spark.createDataFrame([(n, " ".join(item)) for n, item in words.items()], "item_id bigint, text string")
    found = Counter(r.item_id for r in decontaminate.leaks(docs, tests).collect())
    assert found == {n: n + 1 for n in words}
    assert decontaminate.without_leaks(docs, tests).isEmpty()


def test_short_items(spark):
    tests = spark.createDataFrame([(1, "one"), (2, "two words"), (4, "four words in all"), (0, "")], "item_id bigint, text string")
    texts = ["words two", "these two words", "x four words in all y", "four words here in all", "only One."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = decontaminate.leaks(docs, tests).collect()
    assert sorted((r.doc_id, r.item_id, r.covered_words, r.tiles) for r in rows) == [(1, 2, 2, "1:0:2"), (2, 4, 4, "1:0:4"), (4, 1, 1, "1:0:1")]
    assert leak_rows(docs, tests) == plain_leaks(pairs_of(docs, "doc_id"), pairs_of(tests, "item_id"))


def test_leaks_awkward(awkward, nothing, planted):
    tests = awkward.selectExpr("doc_id AS item_id", "text", "marker")
    short = [(k, text) for k, text in pairs_of(awkward, "doc_id") if len(text or "") < 10_000]
    some = {k: n for k, n in leak_rows(awkward, tests).items() if k[0] != 7 and k[1] != 7}
    assert some == plain_leaks(short, short)
    assert (7, 7) in {k[:2] for k in leak_rows(awkward, tests)}
    assert decontaminate.without_leaks(awkward, tests).columns == awkward.columns
    assert decontaminate.leaks(nothing, tests).count() == 0
    assert decontaminate.leaks(awkward, tests.limit(0)).count() == 0


def test_quality(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r.doc_id: r.quality for r in labels.collect()}
    tested = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == known[r.doc_id] for r in tested) >= 0.95 * len(tested)
    # Labels that are held out have no say.
    turned = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    assert {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()} == pytest.approx({r.doc_id: r.score for r in rows})


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (8, 0), (9, 1), (99, 1)], "doc_id bigint, quality int")
    rows = quality.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.good_documents(awkward, labels).columns == awkward.columns
    assert quality.quality_scores(nothing, labels).count() == 0 and quality.good_documents(nothing, labels).count() == 0


def test_isotonic():
    draw = np.random.default_rng(1)
    n, y = draw.integers(1, 9, 60).astype(float), draw.normal(size=60).cumsum() / 4 + draw.normal(size=60)
    got = quality.isotonic(y * n, n)
    want = [max(min(np.average(y[i : j + 1], weights=n[i : j + 1]) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert got == pytest.approx(want)


def test_one_per_group(awkward):
    kept = ngram_join.one_per_group(awkward, size=5, per_cent=80)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, 9, 10, None, None])


def test_pipeline(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], medium))
    good, single, clean, mixed, sharded = steps[1:]
    assert all(s.columns == docs.columns for s in (good, single, clean, mixed))
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, spark.read.parquet(f"{medium}/labels.parquet")).collect()}
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps[1:]]
    assert ids[0] == sorted(k for k, v in scores.items() if v)
    words = {k: re.findall("[^\x20\x09-\x0d]+", given[k].text.lower()) for k in ids[0]}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    near = defaultdict(set)
    holders = defaultdict(list)
    for k in ids[0]:
        for other, common in Counter(o for g in sets[k] for o in holders[g]).items():
            if common >= 0.8 * (len(sets[k]) + len(sets[other]) - common):
                near[k].add(other)
                near[other].add(k)
        for g in sets[k]:
            holders[g].append(k)
    left, want = set(ids[0]), []
    while left:
        group = [min(left)]
        for k in group:
            group += [o for o in near[k] if o in left and o not in group]
        left -= set(group)
        want.append(min(group))
    assert ids[1] == sorted(want)
    items = pairs_of(spark.read.parquet(f"{medium}/benchmark.parquet"), "item_id")
    leaked = {k[0] for k in plain_leaks([(k, given[k].text) for k in ids[1]], items)}
    assert leaked and ids[2] == [k for k in ids[1] if k not in leaked]
    assert max(Counter(ids[3]).values()) == 2 and set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert sharded.columns == [*docs.columns, "shard", "slot"]
    per_shard = Counter(r.shard for r in sharded.collect())
    assert len(per_shard) == 24 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_pipeline_of_nothing(spark, small, nothing, tmp_path):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    assert docs.count() == 0
