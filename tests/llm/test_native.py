"""Exact dedup, mixing, sharding and licences against plain Python."""

from __future__ import annotations

import hashlib
import re
import string
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from compare import value
from pyspark.sql import functions as F

from assetlens.llm import exact_dedup, license_scan, mixing, sharding
from assetlens.llm.queries import llm_queries, llm_sql



def as_multiset(rows):
    return Counter(tuple(value(v) for v in r) for r in rows)


WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = llm_queries()[name](spark, small)
    columns = sorted(found.columns)
    expected = con.sql(llm_sql()[name])
    assert sorted(expected.columns) == columns
    want = expected.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert as_multiset(found.select(*columns).collect()) == as_multiset(want)


def test_exact_dedup_awkward(awkward):
    rows = exact_dedup.exact_groups(awkward, carry=[F.col("text").alias("text")]).collect()
    assert len(rows) == awkward.count()
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r)
    for members in groups.values():
        ids = [r.doc_id for r in members if r.doc_id is not None]
        assert {r.group_size for r in members} == {len(members)}
        assert {r.keep_id for r in members} == {max(ids, default=None)}
        assert sum(r.kept for r in members) == 1
        assert next(r for r in members if r.kept).doc_id == max(ids, default=None)


def test_exact_dedup_long_shared_prefix(spark):
    texts = ["p" * 5000 + "a", "p" * 5000 + "b", "P" * 5000 + "A", "q" * 5001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert kept == {0: (2, 2, False), 1: (1, 1, True), 2: (2, 2, True), 3: (3, 1, True)}


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', uuid()) AS text")
    rows = exact_dedup.exact_groups(docs).filter("group_size > 1").collect()
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {2997} and sum(r.kept for r in rows) == 1


def filled(sizes: dict, share=1.5, most=2.0) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while left:
        rest = share * sum(sizes.values()) - sum(fixed.values())
        amount = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if amount[s] > most * sizes[s]}
        if not over:
            return fixed | amount
        fixed |= {s: most * sizes[s] for s in over}
        left -= over
    return fixed


def test_mix(spark, medium):
    rows = mixing.mix_sizes(spark.read.parquet(f"{medium}/documents.parquet").withColumn("rank", F.lit(1))).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    sizes, taken, largest, targets = Counter(), Counter(), Counter(), {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == len(WORD.findall(docs[r.doc_id].text))
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
        targets[source] = r.target
    want = filled(sizes)
    for source in sizes:
        assert targets[source] == pytest.approx(want[source])
        assert abs(taken[source] - targets[source]) <= 2 * largest[source]


def test_mix_awkward(awkward, nothing):
    rows = mixing.mix_sizes(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert as_multiset(rows) == as_multiset(mixing.mix_sizes(awkward.repartition(5)).collect())
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    assert sum(r.taken for r in rows) == sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def check_shards(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, medium):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = sharding.shard_rows(spark.read.parquet(f"{medium}/documents.parquet")).collect()
    assert len(rows) == len(docs)
    check_shards(rows, 24)
    by_source = defaultdict(Counter)
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by_source[docs[r.doc_id].source][r.shard] += 1
    for source, counts in by_source.items():
        even = sum(counts.values()) / 24
        assert all(abs(counts[s] - even) <= 2 for s in range(24)), source


def test_shards_awkward(spark, awkward, nothing, tmp_path):
    rows = sharding.shard_rows(awkward).collect()
    check_shards(rows, 24)
    assert {r["size"] for r in rows if r.doc_id in (3, 4)} == {8}
    sharded = sharding.shard_documents(awkward, 3)
    assert sharded.columns == [c for c in awkward.columns if c != "shard"] + ["shard", "slot"]
    check_shards(sharded.collect(), 3)
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == awkward.count()
    assert sharding.shard_rows(nothing).count() == 0 and sharding.shard_documents(nothing).count() == 0


def test_ranks_repeated_ids(spark):
    docs = spark.range(2000).selectExpr("IF(id < 1500, 7, id) AS doc_id", "'t' AS text", "IF(id % 3 = 0, NULL, 's') AS source")
    check_shards(sharding.shard_rows(docs).collect(), 24)


def test_licenses(spark, awkward, nothing):
    known = license_scan.known_licenses(spark)
    rows = license_scan.license_scan(awkward, known).collect()
    assert len(rows) == awkward.count()
    got = {r.doc_id: (r.license, r.notices) for r in rows if r.doc_id}
    assert got[9] == (None, "MIT") and got[10] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0") and got[1] == (None, None)
    assert license_scan.license_scan(nothing, known).count() == 0
    assert license_scan.license_scan(awkward, known.limit(0)).filter("license IS NOT NULL OR notices IS NOT NULL").count() == 0


def test_whole_license(spark):
    name, text = license_scan.KNOWN[0]
    typed = "Copyright © 2019 A. Person\n\n" + text.upper().replace("LICENSE", "LICENCE").replace(" ", "\n  ").replace('"', "''")
    docs = spark.createDataFrame([(1, typed), (2, typed + " extra")], "doc_id bigint, text string")
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs, license_scan.known_licenses(spark)).collect()}
    assert got == {1: name, 2: None}


def found_licenses(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = license_scan.license_scan(docs, license_scan.known_licenses(spark)).collect()
    return {r.doc_id: (r.license, r.notices) for r in rows}


def test_full_licenses(spark):
    folder = Path(license_scan.__file__).parent / "licenses"
    names = sorted(p.stem for p in folder.iterdir())
    assert names == sorted(license_scan.FULL) and {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} < set(names)
    texts = [(folder / f"{name}.txt").read_text() for name in names]
    # As a comment, and wrapped anew within paragraphs but for copyright lines.
    wrap = lambda p: textwrap.indent(p, "# ") if re.search(r"(?i)copyright \(c\)", p) else textwrap.fill(p, 61, initial_indent="# ", subsequent_indent="# ")
    wrapped = ["\n\n".join(map(wrap, t.split("\n\n"))) for t in texts]
    got = found_licenses(spark, texts + wrapped)
    assert [got[k][0] for k in range(2 * len(names))] == names + names


def test_license_variants(spark):
    apache = (Path(license_scan.__file__).parent / "licenses/Apache-2.0.txt").read_text()
    cases = [
        (license_scan.MIT_TERMS, "MIT"),
        (f"The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n{license_scan.MIT_TERMS}", "MIT"),
        (license_scan.KNOWN[4][1].replace("BSD 3-Clause License. ", "").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
        (apache[: apache.index("END OF TERMS")], "Apache-2.0"),
        (apache[: apache.index("   APPENDIX")], "Apache-2.0"),
        (license_scan.MIT_TERMS[:-30], None),
    ]
    got = found_licenses(spark, [text for text, _ in cases])
    assert [got[k][0] for k in range(len(cases))] == [name for _, name in cases]


def test_copyright_lines(spark):
    heads = [
        "Copyright (c) Microsoft Corporation.",
        "Copyright (c) Facebook, Inc. and its affiliates.",
        "Copyright: 2020 X",
        "Copyright: A. Person <a@b.example>",
        "Copyright Microsoft Corporation",
        "Copyright The Foo Authors. All rights reserved.",
        "© A. Person",
        "(c) Microsoft Corporation. All rights reserved.",
        "\u00a9\u00a02020\u00a0\u2014 A. Person",
        "Copyright\u00a0(c)\u00a02020 A",
    ]
    got = found_licenses(spark, [f"MIT License\n\n{head}\n\n{license_scan.MIT_TERMS}" for head in heads])
    assert got == {k: ("MIT", "MIT") for k in range(len(heads))}


def test_licence_after_copyright(spark):
    lines = {
        "Copyright 2020 The Foo Authors. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "# Copyright (c) Foo, Inc. All rights reserved. Released under the MIT License.": "MIT",
        "Copyright 2020 X \u2014 SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        f"Copyright (c) 2020 X. {license_scan.MIT_TERMS}": "MIT",
        "Copyright 2020 Released Software Ltd.": None,
    }
    got = found_licenses(spark, list(lines))
    assert [got[k] for k in range(len(lines))] == [(name, name) for name in lines.values()]


def test_unicode_marks(spark):
    mit = license_scan.MIT_TERMS
    typed = [
        mit.replace('"AS IS"', "\u201cAS IS\u201d"),
        mit.replace(", free of charge,", "\u2014free of charge\u2014"),
        mit.replace(" ", "\u00a0"),
        "\ufeff\u2022 " + mit.replace("Software", "Soft\u00e9ware", 1),
        "\ufeff\u2022 " + mit,
    ]
    got = found_licenses(spark, typed)
    assert [got[k][0] for k in range(5)] == ["MIT", "MIT", "MIT", None, "MIT"]


def test_sentences_on_copyright_stay(spark):
    """Lines of licences that begin with "copyright" or "(c)" name no holder, however they are wrapped."""
    name, bsd = license_scan.KNOWN[4]
    texts = [re.sub(r"(?i) (?=copyright|notice|holder|owner)", "\n", bsd), re.sub(r"(?i) (?=copyright)", "\n", bsd)]
    apache = (Path(license_scan.__file__).parent / "licenses/Apache-2.0.txt").read_text()
    gpl = (Path(license_scan.__file__).parent / "licenses/GPL-3.0.txt").read_text()
    texts += [re.sub(r"(?i) (?=copyright(?! \(c\)| \[| owner\])|\(c\) y)", "\n", t) for t in (apache, gpl)]
    got = found_licenses(spark, texts)
    assert [got[k][0] for k in range(4)] == [name, name, "Apache-2.0", "GPL-3.0"]


def test_standard_notices(spark):
    lines = {
        '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file': "Apache-2.0",
        "# SPDX-License-Identifier: GPL-2.0-or-later\ncode": "GPL-2.0",
        "x\n/* SPDX-License-Identifier: AGPL-3.0-only */\ny": "AGPL-3.0",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicence, v. 2.0.": None,
        "LICENCED under the MIT licence\nbody": "MIT",
    }
    got = found_licenses(spark, list(lines))
    assert [got[k][1] for k in range(len(lines))] == list(lines.values())


def test_empty_exact(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_digest_is_plain(spark, corpus, small):
    rows = llm_queries()["op1_exact_dedup"](spark, small).collect()
    texts = {r.doc_id: (r.text or "").translate(LOWER) for r in corpus}
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
