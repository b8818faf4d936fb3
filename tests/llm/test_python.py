"""Archives, secrets and token counts against the libraries and plain Python."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from assetlens.llm import secret_scan, token_counts, warc


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(token_counts.tokenizer_path())


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts(spark, medium, library):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(texts)
    want = dict(zip(texts, counted(library, list(texts.values())), strict=True))
    for r in rows:
        assert (r.n_tokens, r.n_bytes) == (want[r.doc_id], len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 512)


def test_counts_awkward(awkward, nothing, library):
    rows = token_counts.token_counts(awkward).collect()
    texts = [r.text or "" for r in awkward.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(counted(library, texts))
    assert token_counts.token_counts(nothing).count() == 0


def test_counts_random(library):
    counter = token_counts.merges(token_counts.tokenizer_path())
    draw = random.Random(5)
    alphabet = [*"abcde  \n\t'st!?.,19", "<|endoftext|>", "é", "中", "𝄞", " ", " ", "\x85", "\x1c", "ſ", "İ", "​", "́", "²", "Ⅷ", "\x00"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == counted(library, texts)


def test_long_piece(library, monkeypatch):
    counter = token_counts.merges(token_counts.tokenizer_path())
    texts = ["a" * 20_000, "word " * 5_000, "<|endoftext|>" * 3 + "  \n x"]
    assert [counter.count(t) for t in texts] == counted(library, texts)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    assert [counter.count(t) for t in texts] == counted(library, texts)


PATTERNS = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if (len(m.group(2)) >= 8) if kind == "assign" else len(m.group()) >= (16, 32)[kind == "hex"]:
                spans.append((m.start(), order, kind, m.end()))
    return sorted(spans)


def check_secrets(rows, texts):
    for r in rows:
        spans = plain(texts[r.doc_id] or "")
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        kinds = [s[2] for s in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in PATTERNS)
        assert (r.spans, r.base_sha256) == (joined, hashlib.sha256(joined.encode()).hexdigest())


def test_secrets(spark, medium, tmp_path):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = secret_scan.scan(docs, str(tmp_path / "ledger")).collect()
    assert len(rows) == docs.count() and any(r.spans for r in rows)
    check_secrets(rows, {r.doc_id: r.text for r in docs.collect()})


def test_ledger_is_incremental(spark, awkward, nothing, tmp_path):
    path = str(tmp_path / "ledger")
    first = secret_scan.scan(awkward.filter("doc_id < 8"), path).count()
    assert first == awkward.filter("doc_id < 8").count()
    size = secret_scan.ledger(spark, path).count()
    rows = secret_scan.scan(awkward, path).collect()
    assert len(rows) == awkward.count()
    blobs = awkward.selectExpr("sha2(coalesce(text, ''), 256)").distinct().count()
    entries = secret_scan.ledger(spark, path)
    assert size < entries.count() == entries.select("blob").distinct().count() == blobs
    check_secrets([r for r in rows if r.doc_id], {r.doc_id: r.text for r in awkward.collect()})
    assert secret_scan.scan(awkward, path).count() == len(rows)
    assert secret_scan.ledger(spark, path).count() == blobs
    assert secret_scan.scan(nothing, path).count() == 0


def test_a_second_version_of_the_rules(spark, awkward, tmp_path):
    """Contents are scanned once per version; what an earlier version found stays and isn't mixed in."""
    path = str(tmp_path / "ledger")
    before = {r.blob: r.spans for r in secret_scan.scan(awkward, path).collect()}
    word = secret_scan.Rules("2", (re.compile("alpha", re.I), re.compile("long"), re.compile("zzz")), (bool,) * 3)
    after = secret_scan.scan(awkward, path, rules=word).collect()
    assert len(after) == awkward.count()
    assert {r.n_assign for r in after if r.doc_id in (1, 2)} == {1}
    assert {r.n_access for r in after if r.doc_id == 7} == {60_000}
    entries = secret_scan.ledger(spark, path)
    assert {r.rules: r["count"] for r in entries.groupBy("rules").count().collect()} == {"1": len(before), "2": len(before)}
    assert {r.blob: r.spans for r in secret_scan.scan(awkward, path).collect()} == before
    assert secret_scan.ledger(spark, path).count() == 2 * len(before)


def test_seen_contents_are_not_scanned(spark, awkward, tmp_path):
    """A ledger that is told other findings keeps to them: texts it has are not read again."""
    path = str(tmp_path / "ledger")
    secret_scan.scan(awkward.filter("doc_id = 8"), path)
    told = secret_scan.ledger(spark, path).selectExpr("blob", "rules", "7L AS n_assign", "n_access", "n_hex", "base_sha256", "'told' AS spans")
    other = str(tmp_path / "other")
    told.write.parquet(other)
    rows = {r.doc_id: (r.n_assign, r.spans) for r in secret_scan.scan(awkward, other).collect()}
    assert rows[8] == (7, "told") and rows[1] == (0, "")


def test_archives(spark, awkward, nothing, tmp_path, monkeypatch):
    pages = awkward.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "marker", "row", "size")
    listed = warc.write_archives(pages, str(tmp_path / "warc"))
    rows = warc.read_archives(listed).collect()
    assert len(rows) == pages.count()
    known = [(r.page_id, r.html) for r in pages.collect()]
    by_id = {}
    for page, html in known:
        by_id.setdefault(page, set()).add(html or "")
    groups = defaultdict(list)
    for page, html in known:
        groups[base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()].append(page)
    for r in rows:
        same = groups[r.payload_digest]
        if r.record_type == "revisit":
            assert r.payload is None and r.refers_to == min(p for p in same if p is not None)
        else:
            assert bytes(r.payload).decode() in by_id[r.page_id] and r.refers_to is None
    for digest, same in groups.items():
        kinds = [r.record_type for r in rows if r.payload_digest == digest]
        assert len(kinds) == len(same) and kinds.count("response") == 1
    assert warc.read_archives(warc.write_archives(nothing.selectExpr("id AS page_id", "lang AS url", "text AS html"), str(tmp_path / "none"))).count() == 0


def test_archive_round_trip(spark, medium, tmp_path):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    listed = warc.write_archives(pages, str(tmp_path / "warc"))
    assert listed.agg({"dictionary_bytes": "min"}).first()[0] > 0
    html = {r.page_id: r.html for r in pages.collect()}
    rows = warc.read_archives(listed).collect()
    assert {r.page_id for r in rows} == set(html)
    for r in rows:
        raw = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.payload is None or bytes(r.payload) == raw


def test_small_archive_has_a_dictionary(tmp_path):
    """Too few records to train a dictionary from, but alike; and ones where it would not pay."""
    body = random.Random(3).randbytes(20_000)
    for records, pays in (([b"WARC/1.1\r\n%d " % k + body for k in range(4)], True), ([b"WARC/1.1 alone" + body], False)):
        path = str(tmp_path / f"{len(records)}.warc.zst")
        assert (warc.write_archive(path, records) > 0) == pays
        assert [raw for _, raw in warc.records_of(path)] == records
        assert os.path.getsize(path) < (30_000 if pays else 20_100)


def test_samples_reach_into_long_records():
    one = b"".join(b"%07d " % k for k in range(100_000))
    sample = warc.sampled(one)
    assert len(sample) == warc.RECORD_BYTES and sample.startswith(one[:4096]) and sample.endswith(one[-4096:])
    assert one[len(one) // 2 :][:200_000].find(sample[len(sample) // 2 :][:4096]) >= 0
    assert warc.sampled(one[:60_000]) == one[:60_000]


def test_archives_roll(spark, medium, tmp_path):
    pages = [r.asDict() for r in spark.read.parquet(f"{medium}/pages.parquet").limit(20).collect()]
    records = [warc.record({"payload": p["html"].encode(), "marker": i, "first_marker": None, "page_id": p["page_id"], "url": p["url"], "first_id": None}) for i, p in enumerate(pages)]
    path = str(tmp_path / "one.warc.zst")
    warc.write_archive(path, records)
    assert [raw for _, raw in warc.records_of(path, 100)] == records
    with open(path, "rb") as file:
        whole = file.read()
    with open(path, "wb") as file:
        file.write(whole[:-5])
    with pytest.raises(ValueError):
        list(warc.records_of(path))
