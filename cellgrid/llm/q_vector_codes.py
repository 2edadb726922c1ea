"""Query of operator 12: product codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.vector_codes import compress

NAME = "op12_vector_codes"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned(book: str, name: str) -> str:
    """Least distance first, then least entry, as one number."""
    return f"""
{name} AS (
  SELECT vec_id, part, min(far * 64 + entry) % 64 AS entry, min(far * 64 + entry) // 64 AS far
  FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS far
        FROM comp c JOIN {book} b ON b.part = c.part AND b.place = c.place GROUP BY c.vec_id, c.part, b.entry)
  GROUP BY vec_id, part
)"""


def _moved(book: str, by: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x
  FROM {book} b LEFT JOIN (
    SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS x
    FROM (SELECT c.part, a.entry, c.place, sum(c.x) AS s, count(*) AS n
          FROM comp c JOIN {by} a ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY c.part, a.entry, c.place)
  ) m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
)"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), places AS (
  SELECT vec_id, e, unnest(range(len(e))) AS i FROM kept
), comp AS (
  SELECT vec_id, i // (len(e) // 16) AS part, i % (len(e) // 16) AS place,
         CAST(floor(256 * CAST(e[i + 1] AS DOUBLE)) AS HUGEINT) AS x
  FROM places
), book0 AS (
  SELECT part, entry, place, x FROM comp
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)
), {_assigned("book0", "a0")}, {_moved("book0", "a0", "book1")}, {_assigned("book1", "a1")}, {_moved("book1", "a1", "book2")},
{_assigned("book2", "a2")}, coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
