"""Secrets in every version of every text, by a ledger of scanned contents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import frames

KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rules:
    """A version's pattern per kind, in the order of KINDS, and what a match must have to count."""

    version: str
    patterns: tuple[re.Pattern, ...]
    holds: tuple[Callable[[re.Match], bool], ...]


#: The pattern of each kind, and what a match must have.
RULES = Rules(
    "1",
    (
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        re.compile(r"AKIA[A-Z0-9]+"),
        # A run of 32 or more starts where the run of any length starts.
        re.compile(r"[0-9a-f]{32,}"),
    ),
    (lambda m: len(m.group(2)) >= 8, lambda m: len(m.group()) >= 16, lambda m: True),
)
FINDINGS = "blob string, rules string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def found(text: str, rules: Rules) -> tuple[list[int], str]:
    """Matches per kind, and `kind:start:end` of all by start, then kind, joined by commas."""
    spans = [
        (match.start(), order, match.end())
        for order, (pattern, holds) in enumerate(zip(rules.patterns, rules.holds, strict=True))
        for match in pattern.finditer(text)
        if holds(match)
    ]
    counts = [sum(1 for s in spans if s[1] == order) for order in range(len(KINDS))]
    return counts, ",".join(f"{KINDS[order]}:{start}:{end}" for start, order, end in sorted(spans))


def scanned(rules: Rules):
    """Arrow function over (blob, text): findings per blob; one that a task sees twice is scanned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for blob, text in zip(batch.column(0), batch.column(1), strict=True):
                address = blob.as_py()
                if (key := bytes.fromhex(address)) in seen:
                    continue
                seen.add(key)
                counts, spans = found(text.as_py(), rules)
                rows.append((address, rules.version, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Findings per blob and version of the rules; empty where nothing is written yet."""
    try:
        return spark.read.schema(FINDINGS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDINGS)


def scan(
    versions: DataFrame,
    ledger_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Rules = RULES,
) -> DataFrame:
    """Per row of `versions` (every version of every path): its id and what its text holds.

    1. Each version gets the address of its content, the SHA-256 of its text. Of the versions with
       one address the smallest id stands for it.
    2. Addresses that the ledger at `ledger_path` has no entry for under this version of the rules are
       unseen: new contents, and under a new version all of them. Entries of other versions stay.
       A second scan reads the texts that stand for them; a bitmap of fixed size lets the others
       be skipped without a shuffle of texts. What it lets through needlessly gives an entry
       that is there already, and is left out.
    3. New entries are appended to the ledger, whose entries are joined to all versions.

    An interrupted run leaves the ledger as it was or with complete entries; the same entry
    written twice counts once. Missing and empty texts have no secrets. Ids may be missing or
    repeat. An empty table gives an empty one; further columns are not read.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.sha2(text, 256)
    addressed = frames.staged(versions.select(F.col(id_col).alias("id"), blob.alias("blob")), "addresses")
    known = ledger(spark, ledger_path).filter(F.col("rules") == rules.version).select("blob").distinct()
    standing = addressed.groupBy("blob").agg(F.min("id").alias("id"))
    unseen = frames.staged(standing.join(known, "blob", "left_anti"), "unseen")
    read = versions.select(F.col(id_col).alias("id"), text.alias("text"), blob.alias("blob"))
    read = frames.with_possible(read, frames.slot_bitmaps(unseen.select("blob", "id")), "blob", "id")
    entries = read.filter("possible").select("blob", "text").mapInArrow(scanned(rules), FINDINGS)
    entries = entries.dropDuplicates(["blob"]).join(unseen.select("blob"), "blob", "left_semi")
    entries.select(*spark.createDataFrame([], FINDINGS).columns).write.mode("append").parquet(ledger_path)
    entries = ledger(spark, ledger_path).filter(F.col("rules") == rules.version).drop("rules")
    return (
        addressed.join(frames.staged(entries.dropDuplicates(["blob"]), "findings"), "blob")
        .select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
    )
