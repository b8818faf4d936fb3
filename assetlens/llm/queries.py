"""The operators as registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import (
    decontaminate,
    exact_dedup,
    frames,
    license_scan,
    manifest,
    mixing,
    ngram_join,
    piece_codec,
    quality,
    ranked_search,
    secret_scan,
    sharding,
    token_counts,
    warc,
)

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("text_sha256")
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry=[digest])


OP1_SQL = f"""
WITH n AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op2_tiled_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS weight,
             2 * source_size AS room FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY room / weight, k) AS pos,
         ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5
          - coalesce(sum(room) OVER (ORDER BY room / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY room / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight
  FROM w),
f AS (SELECT *, min((room <= per_weight * weight)::INT) OVER (ORDER BY pos) AS filled FROM r),
p AS (
  SELECT k, source_size,
         CASE WHEN filled = 1 THEN room::DOUBLE
              ELSE (SELECT arg_min(per_weight, pos) FROM f WHERE filled = 0) * weight END AS target,
         ('0x' || substr(md5('17:' || k), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS u
  FROM f),
o AS (
  SELECT d.*, p.source_size, p.target, p.u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY k ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) AS i
  FROM d JOIN p USING (k))
SELECT doc_id, size, source_size, target,
       (floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT * size AS taken
FROM o
"""


def op8_source_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


#: crc32 of bytes by the table of its 256 steps.
OP8_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(b::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, bit: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS step),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         md5('23:' || coalesce(doc_id::VARCHAR, '')) AS draw,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes
  FROM documents),
c AS (
  SELECT * EXCLUDE (bytes, step), xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, bytes), lambda crc, b: xor(crc >> 8, step[((xor(crc, b) & 255) + 1)::INT])))::BIGINT AS text_crc32
  FROM d, steps),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY k ORDER BY draw, doc_id NULLS FIRST) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY k) AS fraction, count(*) OVER () AS total FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY fraction, k, draw) - 1 AS place FROM r),
s AS (SELECT *, place * 24 // total AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard,
       (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s
"""


def op5_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(archives, payloads=False).drop("url", "archive", "at")


#: A SHA-1 in hexadecimal, by five digits at a time, as four letters of base 32.
BASE32_SQL = "list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda bits: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr({0}, 5 * i::INT + 1, 5))::BIGINT >> bits) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '')"
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id, sha1(payload) AS digest FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {BASE32_SQL.format("digest")} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op6_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), size=3, per_cent=90).drop("set_id")


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM d),
sized AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
tokens AS (SELECT doc_id, n, unnest(s) AS token FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b
  ON a.token = b.token AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, n AS n_shingles, component_id
FROM sized JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = doc_id
"""


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries to one ledger: the second, of all documents, scans only contents that the first hadn't."""
    docs = table(spark, sf_dir, "documents")
    ledger = frames.new_path(spark, "ledger")
    secret_scan.scan(docs.filter("crc32(cast(doc_id AS string)) % 2 = 0"), ledger)
    return secret_scan.scan(docs, ledger).drop("blob")


#: Of a kind: its name, its pattern, and which group must have how many characters.
SECRET_SQL = [
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]


def spans_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a kind: what lies between them tells where they start."""
    return f"""
  SELECT doc_id, {order} AS kind, '{kind}' AS name, begins, begins + length(m) AS ends FROM (
    SELECT doc_id, unnest(found) AS m, unnest(groups) AS g, unnest(list_transform(range(1, len(found) + 1), lambda i:
      list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0)))::BIGINT AS begins
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS groups,
                 string_split_regex(t, '{pattern}') AS gaps FROM d))
  WHERE length(g) >= {least}"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(spans_sql(i, *kind) for i, kind in enumerate(SECRET_SQL))}),
listed AS (
  SELECT doc_id, string_agg(name || ':' || begins || ':' || ends, ',' ORDER BY begins, kind) AS spans,
         count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(
        table(spark, sf_dir, "documents"), license_scan.known_licenses(spark)
    )


def op10_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_ids(table(spark, sf_dir, "documents"), digests=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without_breaks = F.replace("text", F.lit("\n"), F.lit(""))
    tampered = {"text": F.when(even, without_breaks).otherwise(F.col("text"))}
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered=tampered).drop("proof")


def h_sql(*values: str) -> str:
    parts = (f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values)
    return f"sha256({' || '.join(parts)})"


#: crc32, bit by bit, over the characters of a decimal number.
CRC_SQL = """xor(4294967295, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, c: list_reduce(
    list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, bit: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"""
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp,
         CASE WHEN {CRC_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, grp, {h_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
         {h_sql("doc_id", "source", "lang", "n_chars", "tampered")} AS other
  FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY grp) AS n
  FROM leaves),
tree AS (
  SELECT grp, 0 AS level, n, place, leaf AS h FROM placed
  UNION ALL
  SELECT grp, any_value(level) + 1, (any_value(n) + 2) // 3, place // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM tree WHERE n > 1 GROUP BY grp, place // 3),
subroots AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, n, place, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, (any_value(n) + 2) // 3, place // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM top WHERE n > 1 GROUP BY place // 3),
heights AS (SELECT grp, max(level) AS height FROM tree GROUP BY grp),
steps AS (
  SELECT p.doc_id, t.level,
         coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place < p.place // (3 ** t.level)::BIGINT), '') AS ahead,
         coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place > p.place // (3 ** t.level)::BIGINT), '') AS behind
  FROM placed p JOIN tree t ON t.grp = p.grp AND t.n > 1 AND t.place // 3 = p.place // (3 ** (t.level + 1))::BIGINT
  GROUP BY p.doc_id, t.level
  UNION ALL
  SELECT p.doc_id, any_value(height) + t.level,
         coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place < s.place // (3 ** t.level)::BIGINT), ''),
         coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place > s.place // (3 ** t.level)::BIGINT), '')
  FROM placed p JOIN heights USING (grp) JOIN subroots s USING (grp)
  JOIN top t ON t.n > 1 AND t.place // 3 = s.place // (3 ** (t.level + 1))::BIGINT
  GROUP BY p.doc_id, t.level),
folds AS (
  SELECT doc_id, 0::BIGINT AS level, other AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(s.ahead || f.h || s.behind)
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level),
proofs AS (SELECT doc_id, sha256(string_agg(ahead || behind, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       l.h AS folded_root, l.h = r.h AS verified
FROM placed p JOIN subroots s USING (grp) CROSS JOIN (SELECT h FROM top WHERE n = 1) r
LEFT JOIN proofs USING (doc_id)
JOIN (SELECT doc_id, arg_max(h, level) AS h FROM folds GROUP BY doc_id) l ON l.doc_id = p.doc_id
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS.format(LOWER.format("coalesce(text, '')"))} AS terms FROM documents),
sized AS (SELECT doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({TERMS.format(LOWER.format("coalesce(text, '')"))}) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_tiled_leaks": op2_tiled_leaks,
        "op3_quality_scores": op3_quality_scores,
        "op4_source_mix": op4_source_mix,
        "op5_dictionary_warc": op5_dictionary_warc,
        "op6_ngram_groups": op6_ngram_groups,
        "op7_secret_ledger": op7_secret_ledger,
        "op8_source_shards": op8_source_shards,
        "op9_license_digests": op9_license_digests,
        "op10_bpe_counts": op10_bpe_counts,
        "op11_piece_codec": op11_piece_codec,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_ranked_search": op13_ranked_search,
    }


def llm_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op4_source_mix": OP4_SQL,
        "op5_dictionary_warc": OP5_SQL,
        "op6_ngram_groups": OP6_SQL,
        "op7_secret_ledger": OP7_SQL,
        "op8_source_shards": OP8_SQL,
        "op12_merkle_manifest": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
    }
