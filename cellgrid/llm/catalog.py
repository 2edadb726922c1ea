"""Registry of the text queries; each module adds its own query and, where SQL can say it, the SQL."""

from __future__ import annotations

from cellgrid.llm import (
    q_bpe,
    q_class_lm,
    q_fingerprints,
    q_html_text,
    q_language_id,
    q_line_dedup,
    q_merkle_manifest,
    q_near_dedup,
    q_packing,
    q_quality,
    q_quality_classifier,
    q_suffix_dedup,
    q_vector_codes,
)

MODULES = (q_line_dedup, q_bpe, q_language_id, q_quality, q_suffix_dedup, q_class_lm, q_quality_classifier, q_packing, q_fingerprints, q_near_dedup,
           q_merkle_manifest, q_vector_codes, q_html_text)

QUERIES = {m.NAME: m.run for m in MODULES}
ORACLES = {m.NAME: m.SQL for m in MODULES if m.SQL}
