"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from assetlens.llm import manifest, queries
from compare import duck, spark_rows, sql_rows, type_differences


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(hashes):
    """The last node, and per leaf what stands before and after its node at each level."""
    paths, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for path, at in zip(paths, place, strict=True):
            start = at - at % 3
            path.append(("".join(hashes[start:at]), "".join(hashes[at + 1 : start + 3])))
        place = [at // 3 for at in place]
        hashes = [h(*hashes[k : k + 3]) for k in range(0, len(hashes), 3)]
    return hashes[0], paths


def plain(rows, tamper):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], plain_leaf(*row), plain_leaf(*row[:4], tamper(row[0], row[4]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for name in names:
        group = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made.append((group, *plain_tree([leaf for _, leaf, _ in group])))
    root, upper = plain_tree([subroot for _, subroot, _ in made])
    out = []
    for (group, subroot, paths), above in zip(made, upper, strict=True):
        for (doc_id, leaf, other), path in zip(group, paths, strict=True):
            node = other
            for before, after in path + above:
                node = h(before, node, after)
            out.append((doc_id, leaf, subroot, root, h(*(b + a for b, a in path + above)), node, node == root))
    return sorted(out, key=repr)


def cut(doc_id, text):
    even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
    return text.replace("\n", "") if even and text is not None else text


def tampered():
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def rows_of(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def found(df):
    return sorted(map(tuple, df.drop("proof").collect()), key=repr)


def test_query(spark, small):
    expected = plain(rows_of(spark.read.parquet(f"{small}/documents.parquet")), cut)
    assert found(queries.op12_merkle_manifest(spark, small)) == expected
    assert {row[-1] for row in expected} == {True, False}


def test_sql(spark, medium):
    connection = duck(medium)
    df = queries.op12_merkle_manifest(spark, medium)
    assert spark_rows(df) == sql_rows(connection, queries.OP12_SQL)
    assert not type_differences(df, connection, queries.OP12_SQL)


def test_awkward_and_empty(awkward, nothing):
    assert found(manifest.manifest(awkward, tampered=tampered())) == plain(rows_of(awkward), cut)
    assert manifest.manifest(nothing).count() == 0


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 4], [9, 10, 27, 28], [1, 82, 7, 1]])
def test_sizes(spark, monkeypatch, sizes):
    """Groups that end at every place of a run, and of blocks of nine."""
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rows = [(100 * g + k, "group", None, k, f"{g} {k}\n") for g, n in enumerate(sizes) for k in range(n)]
    rows = [(i, None if i < 100 else f"{i // 100}{'é' * (i // 100)}", lang, n, text) for i, _, lang, n, text in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(manifest.manifest(docs, tampered=tampered())) == plain(rows, cut)


def test_proof_is_given(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    row = manifest.manifest(docs).filter("doc_id = 7").first()
    node = row.leaf
    for step in row.proof:
        node = h(step.before, node, step.after)
    assert node == row.root and row.verified


def test_one_exchange_per_pass(spark, small):
    """All levels of a pass share an exchange and a sort."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select(
        F.lit("").alias("grp"), F.col("n_chars").alias("n"), F.col("doc_id").alias("at"), F.lit("0").alias("hash")
    )
    plan = manifest.climbed(rows)._jdf.queryExecution().sparkPlan().toString()
    full = manifest.climbed(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= manifest.LEVELS
    assert full.count("Exchange ") == 1 and full.count("Sort ") == 1
