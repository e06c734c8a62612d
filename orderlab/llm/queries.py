"""Registered queries of the training-data operators (opN_<name>) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlab.llm import (
    bpe, decontaminate, hmm_lm, lang_id, lexical_search, mixing, near_dup, page_diff, quality, secret_scan, spelling,
    tool_calls, url_filter,
)
from orderlab.llm.common import read_table


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.blocked(url_filter.page_captures(pages), url_filter.page_lists(pages))
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


def op1_hmm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents"))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tool_calls.conversation_parts(read_table(spark, sf_dir, "conversations"))
    return tool_calls.link(*parts, tool_calls.SCHEMAS)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed", "kept", "llr")


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.sample(read_table(spark, sf_dir, "documents"))
    return out.withColumn("weight", F.round("weight", 12)).withColumn("rate", F.round("rate", 6))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents")).drop("found")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(read_table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(read_table(spark, sf_dir, "documents"), width=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read_table(spark, sf_dir, "documents"))


def op12_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT item_id, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
grams AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM grams),
dw AS (
  SELECT doc_id, ks.k, unnest(range(1, len(ws) - ks.k + 2)) AS i, ws FROM w, ks WHERE len(ws) >= ks.k),
hit AS (
  SELECT DISTINCT d.doc_id, d.i, d.k, g.item_id
  FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM dw) d JOIN grams g ON d.k = g.k AND d.g = g.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_lm_scoring": op1_hmm_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_tool_call_linking": op3_tool_call_linking,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_secret_scans": op6_secret_scans,
    "op7_html_extraction": op7_html_extraction,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bpe_encode_decode": op12_bpe_encode_decode,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {
    "op3_tool_call_linking": tool_calls.CONVERSATIONS_SQL,
    "op5_mixing_sources": mixing.sample_sql(),
    "op9_url_filters": url_filter.PAGES_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op13_ranked_lexical_search": lexical_search.SQL,
}
