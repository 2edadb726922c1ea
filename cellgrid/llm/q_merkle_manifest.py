"""Query of operator 11: manifest of all documents, and the proofs of rows of which every seventh was tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import documents
from cellgrid.llm.merkle_manifest import audit

NAME = "op11_merkle_manifest"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                 {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))}))"


def _tree(leaves: str, name: str) -> str:
    """All nodes (grp, lvl, idx, h) of the trees over ``leaves`` (grp, idx, h)."""
    return f"""
{name} AS (
  SELECT grp, 0 AS lvl, idx, h, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // 2, n
)"""


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), rows AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('n_chars + 1')} AS changed,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                         lambda a, d: xor(a >> 8, t[(xor(a, d) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS rid FROM rows
), leaves AS (SELECT coalesce('+' || lang, '') AS grp, idx, leaf AS h FROM placed), {_tree('leaves', 'low')},
subroots AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, grp AS of, h FROM low WHERE n = 1),
tops AS (SELECT grp, idx, h FROM subroots), {_tree('tops', 'high')},
steps AS (
  SELECT rid, l.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.idx < p.idx >> l.lvl THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM placed p JOIN (SELECT DISTINCT grp, lvl FROM low WHERE n > 1) l ON l.grp = coalesce('+' || p.lang, '')
  LEFT JOIN low s ON s.grp = l.grp AND s.lvl = l.lvl AND s.idx = xor(p.idx >> l.lvl, 1)
  UNION ALL
  SELECT rid, 1000 + l.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.idx < u.idx >> l.lvl THEN 'L' || s.h ELSE 'R' || s.h END
  FROM placed p JOIN subroots u ON u.of = coalesce('+' || p.lang, ''), (SELECT DISTINCT lvl FROM high WHERE n > 1) l
  LEFT JOIN high s ON s.lvl = l.lvl AND s.idx = xor(u.idx >> l.lvl, 1)
), paths AS (SELECT rid, list(step ORDER BY lvl) AS path FROM steps GROUP BY rid
), folded AS (
  SELECT p.doc_id, p.leaf, u.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
         sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN hit THEN changed ELSE leaf END, coalesce(path, [])),
                     lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
  FROM placed p JOIN subroots u ON u.of = coalesce('+' || p.lang, '') LEFT JOIN paths USING (rid)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
