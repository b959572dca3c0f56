"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.llm import bpe, chat, knn, language, line_dedup, packing, periodic, prefix_trie, quality, quality_rules, simhash, suffix_dedup, toxicity
from evidence_spark.session import scratch_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = scratch_table(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "packing-lengths")
    return packing.pack(stored).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    "op6_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keys AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, o.key IS NOT NULL AS gone FROM keys k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.without_frequent_lines(_table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_table(spark, sf_dir, "documents")).drop("k1", "k2")


@query(
    "op5_chat_formatting",
    r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(s>|/s>|<SYS>>|</SYS>>)', '\1\\\2', 'g'),
      '(\[)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2', 'g') AS x,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '(<)(s>|/s>|<SYS>>|</SYS>>)', '\1\\\2', 'g'),
      '(\[)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2', 'g') AS r FROM c
), p AS (
  SELECT *, length(x) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 20 + length(r) END AS n FROM e
), w AS (
  SELECT *, 3 + sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last FROM p
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(more)))


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    "op8_top_k_search",
    """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id,
      CAST(CASE WHEN len(q.e) = 0 OR len(c.e) = 0 THEN 0 ELSE list_dot_product(q.e, c.e) END AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
) WHERE rank <= 5""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = scratch_table(knn.scaled(_table(spark, sf_dir, "embeddings")), "knn-scaled")
    return knn.top_k(data, data.filter("vec_id % 50 = 0"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "severity", "p_toxic", "toxic")


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_repeated_tails(_table(spark, sf_dir, "documents"))))


@query("op11_prefix_trie", prefix_trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))
