"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from assetlens.llm import queries, ranked_search
from compare import duck, spark_rows, sql_rows, type_differences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, top=50):
    """(item, rank, doc, score) by scoring all documents for all items."""
    counted = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    big_n, big_l = len(counted), sum(c.total() for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - 50 + (50 * c.total() * big_n) // big_l
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        best = sorted(scored, key=lambda s: s[:3])[:top]
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_and_sql(spark, medium):
    df = queries.op13_ranked_search(spark, medium)
    connection = duck(medium)
    assert spark_rows(df) == sql_rows(connection, queries.OP13_SQL)
    assert not type_differences(df, connection, queries.OP13_SQL)
    items, docs = (
        [tuple(r) for r in spark.read.parquet(f"{medium}/{t}.parquet").select(i, "text").collect()]
        for t, i in (("benchmark", "item_id"), ("documents", "doc_id"))
    )
    assert found(df) == plain(items, docs)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_awkward_and_empty(spark, awkward, nothing, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 1)
        monkeypatch.setattr(ranked_search, "BATCH_TERMS", 1)
    items = [(1, "ALPHA beta, zeta?"), (2, None), (3, ""), (None, "long tail of word"), (5, "ünï ſ k 𝄞"), (1, "secret"),
             (6, "nowhere-found"), (7, "mit licence released under the all rights")]
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id int, text string, marker int, rank string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(ranked_search.search(asked, awkward)) == plain(items, docs)
    assert found(ranked_search.search(asked, nothing)) == []
    assert found(ranked_search.search(asked.filter("false"), awkward)) == []


def rows_of(rng, count, words):
    return [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(count)]


def test_many_ties_and_blocks(spark, monkeypatch):
    """Copies by the hundred share a score; the smallest ids are wanted, wherever they are."""
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 500)
    rng = random.Random(5)
    docs = rows_of(rng, 400, [f"w{k}" for k in range(30)]) + [(1000 + k, "w1 w2 w3 other") for k in range(300)]
    rng.shuffle(docs)
    items = [(0, "w1 w2 w3"), (1, "w4 w5 w6 w7 w8"), (2, "other"), (3, "w1 absent")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for top in (1, 10, 50):
        assert found(ranked_search.search(asked, table, top=top)) == plain(items, docs, top)
