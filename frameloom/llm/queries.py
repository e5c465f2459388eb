"""The queries ``opN_<name>`` of this subpackage and SQL for some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, licenses, minhash, mixing, quality, suffixdedup, tokencount, toxicity, urlrules, warc
from frameloom.llm.shared import table

#: The rule set that the URL query judges by: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity.rate_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select(
        "doc_id", "held_out", "score", "predicted", "n_tokens", F.size("passages").cast("long").alias("n_passages")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(
        table(spark, sf_dir, "documents"),
        tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"),
        cache_path=tokencount.shared_cache(spark, f"{sf_dir.rstrip('/')}/documents.parquet"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_substrings(table(spark, sf_dir, "documents"), threshold=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {}

SQL["op9_url_filters"] = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), part AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM cut
), fit AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
         END AS rule
  FROM part
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""

SQL["op10_warc"] = r"""
WITH seen AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages
), kept AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id,
         regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM seen
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to,
       CASE WHEN rest = '' THEN '' ELSE
         array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '.')), ',') || ')'
         || regexp_extract(rest, '^[^/?#]*(.*)$', 1, 's') END AS url_key,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id % 1073741824 + 1073741824) % 1073741824), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
FROM kept
"""

#: Any 13 aligned tokens with at most 2 that differ have 4 in a row that agree,
#: so this meets on those, and takes no part of the spaced seeds.
SQL["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t
  FROM benchmark
), di AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d
), bj AS (
  SELECT item_id, t, unnest(range(1, len(t) - 2)) AS j FROM b
), hit AS (
  SELECT DISTINCT di.doc_id, bj.item_id, di.i - bj.j AS shift
  FROM di JOIN bj ON array_to_string(di.w[di.i:di.i+3], ' ') = array_to_string(bj.t[bj.j:bj.j+3], ' ')
), near AS (
  SELECT hit.doc_id, hit.item_id, hit.shift, unnest(range(1, len(b.t) - 11)) AS s, d.w, b.t
  FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)
), good AS (
  SELECT DISTINCT doc_id, item_id, shift FROM near
  WHERE s + shift >= 1 AND s + shift + 12 <= len(w)
    AND list_sum(list_transform(range(0, 13), lambda k: (w[s + shift + k] = t[s + k])::int)) >= 11
), per AS (
  SELECT doc_id, count(*) AS n_overlaps, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids FROM good GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(item_ids, '') AS item_ids,
       coalesce(n_overlaps, 0) > 0 AS contaminated
FROM documents LEFT JOIN per USING (doc_id)
"""
