"""The quality classifier and the licence lookup against plain counterparts, over whole tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex

from assetlens.llm import license_scan, quality, queries

KINDS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:\'\"-?()", "!", "|",
]


def share_repeated(items):
    return 1 - len(set(items)) / len(items) if items else 0.0


def plain_statistics(text):
    """The numbers that describe a text, by Python's own strings and sets."""
    raw = text.encode()
    if not raw:
        return [0.0] * 18
    kinds = [sum(chr(b) in kind for b in raw if b < 128) for kind in KINDS]
    beyond = sum(b > 127 for b in raw)
    kinds += [len(raw) - sum(kinds) - beyond, beyond]
    shares = [k / len(raw) for k in kinds]
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text)]
    grams = [[tuple(words[i : i + n]) for i in range(len(words) - n + 1)] for n in (2, 5)]
    lines = 1 + text.count("\n")
    return shares + [
        math.log1p(len(words)),
        math.log1p((1 - shares[3] - shares[4]) * len(raw) / max(len(words), 1)),
        share_repeated(words),
        *map(share_repeated, grams),
        sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0.0,
        math.log1p(len(words) / lines),
        math.log1p(lines),
    ]


def crc(text):
    return zlib.crc32(text.encode())


def plain_scores(docs, labels):
    """Scores from one matrix of all documents: ridge on Fourier features by least squares, then isotonic means."""
    ids = [i for i, _ in docs]
    stats = np.array([plain_statistics(text or "") for _, text in docs])
    deviation = stats.std(axis=0)
    deviation[deviation < 1e-9] = 1.0
    near = np.clip((stats - stats.mean(axis=0)) / deviation, -quality.FAR, quality.FAR)
    draw = np.random.default_rng(quality.SEED)
    directions = draw.normal(size=(18, quality.FEATURES)) / math.sqrt(18)
    shifts = draw.uniform(0, 2 * math.pi, quality.FEATURES)
    features = math.sqrt(2 / quality.FEATURES) * np.cos(near @ directions + shifts)

    def ridge(rows, y):
        """Augmented least squares: the penalty as rows of their own, the constant all but free."""
        penalty = np.full(quality.FEATURES + 1, math.sqrt(quality.RIDGE * len(rows) / quality.FEATURES))
        penalty[-1] = math.sqrt(1e-9)
        x = np.vstack([np.column_stack([rows, np.ones(len(rows))]), np.diag(penalty)])
        return np.linalg.lstsq(x, np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]

    def applied(weights, rows):
        return rows @ weights[:-1] + weights[-1]

    place = {i: k for k, i in enumerate(ids)}
    train = [(place[i], y, crc(f"fold{i}") % quality.FOLDS) for i, y in labels if crc(str(i)) % 3 != 1 and i in place]
    at, y, fold = (np.array(column) for column in zip(*train, strict=True))
    weights = ridge(features[at], y)
    raw = np.zeros(len(at))
    for f in range(quality.FOLDS):
        others = fold != f
        raw[fold == f] = applied(ridge(features[at[others]], y[others]), features[at[fold == f]])
    bins = defaultdict(list)
    for r, label in zip(raw, y, strict=True):
        bins[int(np.clip((r + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1))].append((r, label))
    points = [np.mean([r for r, _ in bins[b]]) for b in sorted(bins)]
    n = np.array([len(bins[b]) for b in sorted(bins)], dtype=float)
    means = np.array([np.mean([label for _, label in bins[b]]) for b in sorted(bins)])
    up = [
        max(min(np.average(means[i : j + 1], weights=n[i : j + 1]) for j in range(k, len(n))) for i in range(k + 1))
        for k in range(len(n))
    ]
    return dict(zip(ids, np.interp(applied(weights, features), points, up), strict=True))


def test_quality_scores(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    want = plain_scores(docs, labels)
    rows = queries.op3_quality_scores(spark, small).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx(want, abs=1e-6)
    assert all(r.held_out == (crc(str(r.doc_id)) % 3 == 1) for r in rows)
    assert len({round(r.score, 6) for r in rows}) > 1


def plain_form(text):
    """A text's canonical form by Python's patterns, the whole text at a time."""
    text = text.translate({c: c + 32 for c in range(65, 91)})
    text = regex.sub(license_scan.NOTICE.replace(r"\z", r"\Z"), "\n", text)
    text = regex.sub(license_scan.RIGHTS, "\n", text)
    words = regex.sub(license_scan.MARKS, " ", text).split()
    same = {other: word for word, other in license_scan.EQUIVALENT if " " not in other}
    joined = f" {' '.join(same.get(w, w) for w in words)} "
    for word, other in license_scan.EQUIVALENT:
        joined = joined.replace(f" {other} ", f" {word} ")
    return joined.strip()


def test_license_digests(spark, small):
    """Every text and every line against every known text, by their forms."""
    known = defaultdict(set)
    for r in license_scan.known_licenses(spark).collect():
        known[plain_form(r.text)].add(r.license)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op9_license_digests(spark, small).collect()
    assert len(rows) == len(docs)
    seen = set()
    for r in rows:
        lines = [plain_form(line) for line in docs[r.doc_id].split("\n")]
        names = {name for line in lines if line for name in known.get(line, ())}
        whole = plain_form("\n".join(docs[r.doc_id].split("\n")))
        assert (r.notices or "") == ",".join(sorted(names))
        assert (r.license or "") == ",".join(sorted(known.get(whole, ()))) or not whole
        seen |= names
    assert seen
