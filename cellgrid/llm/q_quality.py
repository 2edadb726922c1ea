"""Query of operator 4: the quality-rule ledger over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import quality_rules as qr
from cellgrid.llm.common import documents

NAME = "op4_quality_rules"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qr.ledger(documents(spark, sf_dir))
    base_failed = qr.fails("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed.alias("base_failed"), (~base_failed & ~qr.fails(qr.CURRENT)).alias("kept"),
                       "n_bangs", "n_lines", "fail_bits")


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(qr.RULES.values()))

SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS s(o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
         (1 + length(t) - length(replace(t, chr(10), '')))::BIGINT AS n_lines
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
), bits AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {qr.mask_of(qr.POLICIES["base"])}) <> 0 AS base_failed,
       (fail_bits & {qr.mask_of(qr.POLICIES[qr.CURRENT])}) = 0 AS kept, n_bangs, n_lines, fail_bits
FROM bits
"""
