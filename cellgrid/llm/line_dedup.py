"""Line dedup: lines that recur in many documents stay in one of them.

All on DataFrame functions. Lines are exploded as (document, position, hash) without their
text and written once; distinct (hash, document) pairs are counted per hash with partial aggregation, so a
line found everywhere costs one partial row per task. Dropped positions come back by a join
on the hash, which adaptive execution splits where one line is hot, are gathered per
document, and the document is reassembled by position. Whole texts are shuffled once.

Defined results: a null or empty text is one empty line; rows with a null id count as one
document; rows sharing an id are one document for the count, and the line stays in every
row of the document that keeps it; equal rows get equal results; an empty table gives an
empty table; other columns pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import BLANKS, keyed
from cellgrid.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased, other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


#: two 64-bit hashes of the key under different seeds: lines equal in both are taken as equal
_HASH = ["_h1", "_h2"]


def dropped_positions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_id, _th, _drop): 0-based positions of the lines each document loses."""
    at = rows.select("_id", "_th", "_doc", F.posexplode(lines_of(F.col("_text"))).alias("_pos", "_line"))
    at = (at.where(F.char_length("_line") >= min_chars)
          .select("_id", "_th", "_doc", "_pos", line_key(F.col("_line")).alias("_key"))
          .where(F.char_length("_key") >= min_chars)
          .select("_id", "_th", "_doc", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")))
    at = cut_lineage(at)  # lines are split and hashed once, for the counts and for the positions
    holders = at.select(*_HASH, "_doc").distinct()
    common = (holders.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_keeper"))
              .where(F.col("_n") >= min_docs).select(*_HASH, "_keeper"))
    lost = at.join(common, _HASH).where(~F.col("_doc").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_drop"))


def kept_lines(text: Column, drop: Column) -> Column:
    lines = lines_of(text)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.when(drop.isNull(), text).otherwise(
        F.array_join(F.transform(rest, lambda p: F.get(lines, p)), "\n"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row: ``doc_id``, n_lines, n_dropped and the kept text (``kept_text``)."""
    rows = keyed(docs, doc_id, text)
    drops = dropped_positions(rows, min_chars, min_docs)
    # the left side stays the streamed one, so a hot text key is split and never built into a table
    joined = rows.join(drops, ["_id", "_th"], "left")
    return joined.select(
        F.col("_doc").alias(doc_id), F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_drop").isNotNull(), F.size("_drop")), F.lit(0)).cast("long").alias("n_dropped"),
        kept_lines(F.col("_text"), F.col("_drop")).alias("kept_text"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the text of each row reduced to its kept lines; a null text stays null."""
    names = docs.columns
    drops = dropped_positions(keyed(docs, doc_id, text), min_chars, min_docs)
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"),
                        F.coalesce(docs[doc_id], F.lit(0)).cast("long").alias("_id"),
                        F.xxhash64(docs[doc_id], docs[text]).alias("_th"))
    joined = whole.join(drops, ["_id", "_th"], "left")
    return joined.select(*[(kept_lines(F.col(f"_row.`{c}`"), F.col("_drop")) if c == text else F.col(f"_row.`{c}`")).alias(c)
                           for c in names])
