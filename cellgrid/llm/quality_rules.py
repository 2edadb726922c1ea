"""Quality rules as a bitmask ledger.

``measure`` reads every text once. ``ledger`` evaluates every rule once per document and
stores the measurements beside one bit per failed rule. Policies are versioned masks over
those bits: changing a policy never reads a text again, and ablations are counts over the
(few) distinct bit patterns.

Defined results: null text has no words and fails ``too_few_words``; empty tables give
empty ledgers; repeated rows are measured each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import BLANKS, SubstringHash, chunks, mix, per_doc, text_view

#: measurement columns, all long
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines")

#: rule -> condition of failure over the measurements, in bit order (append only: bits are stored)
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "bangs": "100 * n_bangs > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}

#: policy version -> names of the rules whose failure rejects a document
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "bangs"),
    "v2": tuple(RULES),
}
CURRENT = "v2"

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def mask_of(names: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def measure_texts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of each row of a byte view.

    Words and lines are compared by 64-bit hashes within one text only.
    """
    n = len(offs) - 1
    starts_doc = np.zeros(len(data) + 1, bool)
    starts_doc[offs[:-1]] = True
    word = ~_BLANK[data]
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    begins = np.flatnonzero(word & (~before | starts_doc[:len(data)]))
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    ends = np.flatnonzero(word & (~after | starts_doc[1:len(data) + 1])) + 1
    doc_of = np.searchsorted(offs, begins, "right") - 1
    hashes = SubstringHash(data)

    wh = hashes.of(begins, ends)
    repeat = np.zeros(n, np.int64)
    if len(wh) > 2:
        with np.errstate(over="ignore"):
            key = mix(mix(mix(wh[:-2]) + wh[1:-1]) + wh[2:])
            inside = doc_of[:-2] == doc_of[2:]
            key = mix(key + doc_of[:-2].astype(np.uint64))
        at = np.flatnonzero(inside)
        key = key[at]
        order = np.argsort(key)
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(wh), bool)
        for step in range(3):
            covered[at[twice] + step] = True
        repeat = np.bincount(doc_of[covered], minlength=n)

    breaks = np.flatnonzero(data == 10)
    if n:  # line bounds by document, since an empty document shares its offset with the next one
        counts = 1 + per_doc(data == 10, offs)
        line_doc = np.repeat(np.arange(n), counts)
        own = np.concatenate([[0], np.cumsum(counts)[:-1]])
        line_at = np.empty(int(counts.sum()), np.int64)
        first = np.zeros(len(line_at), bool)
        first[own] = True
        line_at[own] = offs[:-1]
        line_at[~first] = breaks + 1
        line_end = np.empty_like(line_at)
        last = np.zeros(len(line_at), bool)
        last[own + counts - 1] = True
        line_end[last] = offs[1:]
        line_end[~last] = breaks
        filled = np.concatenate([[0], np.cumsum(word)])
        busy = filled[line_end] > filled[line_at]
        with np.errstate(over="ignore"):
            lk = mix(hashes.of(line_at[busy], line_end[busy]) + line_doc[busy].astype(np.uint64))
        _, where = np.unique(lk, return_index=True)
        dup = np.bincount(line_doc[busy], minlength=n) - np.bincount(line_doc[busy][where], minlength=n)
    else:
        counts = dup = np.zeros(0, np.int64)
    return {
        "n_words": np.bincount(doc_of, minlength=n),
        "word_chars": per_doc(word & ((data & 0xC0) != 0x80), offs),
        "n_symbols": per_doc(_SYMBOL[data], offs),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "n_bangs": per_doc(data == ord("!"), offs),
        "n_lines": counts,
    }


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of each row's whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            found = measure_texts(*text_view(part.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("_doc"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["_doc", *MEASURES])

    lean = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    out = lean.mapInArrow(run, f"_doc {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return out.withColumnRenamed("_doc", doc_id)


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, measurements and ``fail_bits``: bit i is set if rule i of ``RULES`` fails."""
    return measure(docs, doc_id, text).withColumn("fail_bits", failure_bits())


def fails(policy: str) -> Column:
    """True where the ledger row is rejected under the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) != 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents failing it, and those that only it rejects.

    Counts the distinct bit patterns first, so at most 2^rules rows leave the partial
    aggregation, whatever the number of documents.
    """
    order = list(RULES)
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long"))
    patterns = rows.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this"))


def keep_documents(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their own columns.

    The measurements ride through the same scan as the row itself, so no join is needed.
    """
    names = docs.columns
    lean = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col(text).alias("_text"))
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("_row")).schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            found = measure_texts(*text_view(part.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["_row", *MEASURES])

    judged = lean.mapInArrow(run, f"_row {row}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return judged.withColumn("fail_bits", failure_bits()).where(~fails(policy)).select("_row.*")
