"""The queries of this package and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm import byte_bpe, common, licences, mixing, repetition, sharding, simhash, spotsigs, substrings, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(_table(spark, sf_dir, "documents")).drop("source")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.document_licences(_table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


_ORACLE: dict[str, str] = {}

_ORACLE["op1_source_mixing"] = mixing.oracle()

_ORACLE["op8_warc"] = warc.oracle()

_WINDOWS = """
  {name}_text AS (SELECT doc_id, i, n, string_agg(word, chr(31)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size} - 1 FOLLOWING) AS s FROM x),
  {name}_seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS copies FROM {name}_text WHERE i + {size} - 1 <= n),
  {name} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {size})) AS p FROM {name}_seen WHERE copies > 1) GROUP BY doc_id)"""

_ORACLE["op10_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
  {_WINDOWS.format(name="three", size=3)},
  {_WINDOWS.format(name="least", size=repetition.MIN_REPEAT)},
  {_WINDOWS.format(name="most", size=repetition.MAX_REPEAT + 1)},
  base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
      coalesce(three.n, 0)::BIGINT AS n_repeat_words, coalesce(least.n, 0)::BIGINT AS covered_words, coalesce(most.n, 0) AS over
    FROM w LEFT JOIN three USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN most USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered_words <= {repetition.MAX_COVERED_PERCENT} * n_words AND over = 0 AS kept, covered_words
FROM base"""
