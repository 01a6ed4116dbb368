"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    rest = common.id_text_remainder("doc_id", 4)
    model = toxicity.fit(docs, common.labels(spark, sf_dir).select("doc_id", "toxic"), rest != 2)
    return _judged(toxicity.score_documents(docs, model), F.coalesce(rest == 2, F.lit(False)))


def _judged(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.line_dedup import dedup_lines

    kept = dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from graphloom.llm.packing import pack_documents

    return pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import scan_documents

    return scan_documents(common.documents(spark, sf_dir))


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import quality

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    rest = common.id_text_remainder("doc_id", 5)
    scores = quality.score_documents(docs, common.labels(spark, sf_dir).select("doc_id", "quality"), rest != 0)
    return _judged(scores, F.coalesce(rest == 0, F.lit(False)))


def op6_pstable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(common.embeddings(spark, sf_dir))


def op7_universe_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.shingle_join import join_documents

    return join_documents(common.documents(spark, sf_dir))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ann import search

    return search(common.embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op9_fst_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from graphloom.llm.bpe import encode_documents

    return encode_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import shard_documents

    return shard_documents(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nnpu_toxicity, op2_line_runs, op3_mixture_packing, op4_blob_ledger, op5_additive_quality, op6_pstable_dedup, op7_universe_partition_join, op8_additive_quantisation, op9_fst_bpe, op10_hash_tree_shards)}


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), judged AS (
  SELECT k.*, r.keeper IS NOT NULL AND k.doc_id > r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

SECRETS_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT r, 0 AS number, 'assign' AS kind, regexp_extract_all(t, ASSIGN) AS ms, string_split_regex(t, ASSIGN) AS gaps FROM docs
  UNION ALL SELECT r, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT r, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM docs
), each AS (
  SELECT r, number, kind, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM found
), placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, number ORDER BY i) AS stop FROM each
), good AS (
  SELECT r, number, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
  WHERE CASE number WHEN 0 THEN length(regexp_extract(m, ASSIGN, 2)) >= 8 WHEN 1 THEN length(m) >= 16 ELSE length(m) >= 32 END
), summed AS (
  SELECT r, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
  FROM good GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (r)
""".replace("ASSIGN", """'(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'""")


def oracle_sql() -> dict[str, str]:
    return {"op2_line_runs": LINES_SQL, "op4_blob_ledger": SECRETS_SQL}
