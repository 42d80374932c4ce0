"""The registered queries of these operators, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, media, mixing, packing, quality, secrets, simhash, suffix, toxicity

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_table(spark, sf_dir, "documents"), secrets.default_forest(spark), path="source")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_table(_table(spark, sf_dir, "documents"))


#: Conversation -1: both turns say a text made of control strings.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(ODD_TEXT).alias("text"))
    read = chat.read_back(chat.format_conversations(turns.unionByName(odd)))
    return read.drop("problem")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_media_columns, op2_toxicity, op3_secret_scan, op4_source_mixing, op5_quality_rules, op6_token_counts, op7_simhash, op8_chat_formatting, op9_best_fit_packing, op10_repeated_passages)}
QUERIES["pipeline"] = corpus_pipeline.run

WORD_COUNT = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP4_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {WORD_COUNT}::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null') || chr(1) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM docs GROUP BY source
), shared AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS bound, 2.0::DOUBLE * source_size / weight AS ratio FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM shared WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(bound, first(level) OVER (ORDER BY CASE WHEN level <= ratio THEN 0 ELSE 1 END, ratio, source NULLS LAST) * weight) AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets
), running AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (copies + CASE WHEN upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

OP5_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words, {LINES} AS lines FROM documents
), runs AS (
  SELECT r, i, array_to_string(words[i : i + 7], ' ') AS run FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
), counts AS (
  SELECT doc_id, text, words, lines, len(words)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         length(regexp_replace(text, '[^\p{{Lu}}\p{{Ll}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words OR 2 * capitals > letters
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * len(lines)) OR (5 * len(list_distinct(words)) < n_words AND n_words < 2000)) AS kept
FROM failed
"""


def _escaped(text: str) -> str:
    codes = chat.Template().codes()
    for what, code in codes.items():
        text = f"replace({text}, '{what}', '{chat.Template().escape}{code}')"
    return f"length({text})"


OP8_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TEXT}'
), moves AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len("<|turn|><|say|><|end|>")} + {_escaped("role")} + {_escaped("text")})::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM moves GROUP BY conv_id
"""

OP10_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs)
), first AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY s
), again AS (
  SELECT r, i FROM windows JOIN first USING (s) WHERE doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)
), bytes AS (
  SELECT r, unnest(range(0, len(h) // 2)) AS i FROM docs
), marked AS (
  SELECT b.r, b.i, max(a.i) OVER (PARTITION BY b.r ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS start FROM bytes b LEFT JOIN again a ON a.r = b.r AND a.i = b.i
), gone AS (
  SELECT r, i, start IS NOT NULL AND i - start < 50 AS removed FROM marked
), spans AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM gone
), kept AS (
  SELECT s.r, count(*) FILTER (removed) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(substr(d.h, 2 * s.i + 1, 2), '' ORDER BY s.i) FILTER (NOT removed) AS h
  FROM spans s JOIN docs d ON d.r = s.r GROUP BY s.r
)
SELECT doc_id, (len(docs.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op4_source_mixing": OP4_SQL, "op5_quality_rules": OP5_SQL, "op8_chat_formatting": OP8_SQL, "op10_repeated_passages": OP10_SQL}
