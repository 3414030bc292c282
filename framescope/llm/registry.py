"""The corpus queries registered with the driver, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from framescope.llm import align, decontaminate, dialogue, exact, html, lm, mixing, quality, rules, secrets, simhash, toxicity, warc
from framescope.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.main_text(_table(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.scored(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.domain_totals(_table(spark, sf_dir, "documents"), "source")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).drop("url")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("strength")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audited(_table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicated(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_lm_score": op2_lm_score,
        "op3_decontaminate": op3_decontaminate,
        "op4_simhash": op4_simhash,
        "op5_secrets": op5_secrets,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_warc": op8_warc,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_token_alignment": op12_token_alignment,
        "op13_exact_dedup": op13_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spans AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)),
found AS (SELECT r, item, i, s.n FROM spans s JOIN wins ON s.win = wins.win AND s.n = wins.n),
hit AS (SELECT r, count(*) AS n_hit
        FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

OP9_SQL = r"""
WITH dw AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
        CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(text, chr(10)),
              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM dw LEFT JOIN rep USING (r)),
f AS (SELECT source, rule, n_words, CASE rule
          WHEN 'short' THEN n_words < 10 WHEN 'repeats' THEN 100 * n_repeat_words > 20 * n_words
          WHEN 'symbols' THEN 100 * n_symbols > 10 * word_chars
          ELSE 100 * n_dup_lines > 30 * n_lines END AS bad
      FROM m, (SELECT unnest(['short', 'repeats', 'symbols', 'lines']) AS rule)),
h AS (SELECT source, rule, count(*) AS n, sum(bad::INT) AS k FROM f GROUP BY ALL),
t AS (SELECT rule, sum(k) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts,
             sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM h GROUP BY rule),
s AS (SELECT rule, mean, any_value(room) AS room, CASE WHEN mean > 0 AND mean < 1
             THEN sum(n * (k / n - mean) * (k / n - mean)) / (mean * (1 - mean)) - (any_value(hosts) - 1) ELSE 0 END AS excess
      FROM h JOIN t USING (rule) GROUP BY rule, mean),
p AS (SELECT rule, mean, CASE WHEN excess <= 0 OR room <= 0 THEN 1000 ELSE least(1000, greatest(2, room / excess - 1)) END AS size
      FROM s),
host AS (SELECT source, max((k + size * mean) / (n + size)) > 0.6 AS gone FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT gone AS kept
FROM m JOIN host ON m.source IS NOT DISTINCT FROM host.source"""


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000
      GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)"""


OP13_SQL = """
WITH n AS (SELECT doc_id, row_number() OVER () AS r,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM n"""


def oracle_sql() -> dict[str, str]:
    return {"op13_exact_dedup": OP13_SQL, "op3_decontaminate": OP3_SQL, "op8_warc": OP8_SQL, "op9_quality_rules": OP9_SQL} | (
        {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
