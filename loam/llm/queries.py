"""The queries of this subpackage, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import ann, bpe, chat, langid, linededup, lm, mixing, quality, simhash, topk
from loam.llm._common import settle, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(settle(chat.format_examples(chat.with_added(table(spark, sf_dir, "conversations"))), "examples"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), "row.text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_roundtrip, op2_simhash_components, op3_ann_search, op4_quality_score, op5_exact_topk, op6_mix_sources, op7_chat_format, op8_line_dedup, op9_language_id, op10_lm_score)}


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, 15 + length(role) + length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS chars,
    turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_LINES = r"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
b AS (
  SELECT line, min(struct_pack(doc_id := doc_id, place := place)) AS first FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 10),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) FILTER (WHERE NOT (b.first.doc_id = l.doc_id AND b.first.place = l.place)) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE b.line IS NULL OR (b.first.doc_id = l.doc_id AND b.first.place = l.place)) AS kept
  FROM l LEFT JOIN b ON b.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.kept, '') END AS text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_MIX = r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix ' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM r GROUP BY source),
-- the sources that reach twice their size first come first; budget and weight that are left when each one's turn comes
o AS (
  SELECT *, CAST(1.5 * sum(n) OVER () AS DOUBLE) - coalesce(sum(2 * n) OVER before, 0) AS budget,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
  FROM s WINDOW before AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, budget * w > 2 * n * weight AS is_full, max(budget) FILTER (WHERE budget * w <= 2 * n * weight) OVER () AS rest,
    max(weight) FILTER (WHERE budget * w <= 2 * n * weight) OVER () AS open FROM o),
t AS (SELECT source, n, CAST(CASE WHEN is_full THEN 2 * n ELSE rest * w / open END AS DOUBLE) AS target FROM f),
p AS (SELECT source, n, target, CASE WHEN n > 0 THEN least(CAST(floor(target / n) AS BIGINT), 2) ELSE 0 END AS whole FROM t),
g AS (
  SELECT source, h, sum(size) AS words, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r GROUP BY source, h)
SELECT doc_id, size, n AS source_size, target, CAST(whole * size + CASE WHEN before + words <= target - whole * n THEN size
  WHEN before <= target - whole * n AND words > 0 THEN least(size, floor((target - whole * n - before) / words * size + 1e-6)) ELSE 0 END AS BIGINT) AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source JOIN g ON g.source IS NOT DISTINCT FROM r.source AND g.h = r.h
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": _TOPK, "op6_mix_sources": _MIX, "op7_chat_format": _CHAT, "op8_line_dedup": _LINES}
