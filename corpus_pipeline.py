"""From raw documents to packed training sequences: quality rules, line, near and suffix dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import documents
from cellgrid.llm.line_dedup import dedup_lines
from cellgrid.llm.near_dedup import keep_one
from cellgrid.llm.packing import pack_documents
from cellgrid.llm.quality_rules import keep_documents
from cellgrid.llm.suffix_dedup import remove_repeats
from cellgrid.session import cut_lineage, ship_package


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has that column."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go."""
    ship_package(spark)
    return keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more found in five documents or more stay in one of them."""
    return _measured(dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    ship_package(spark)
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that stands elsewhere too go."""
    ship_package(spark)
    return _measured(remove_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: shingle signatures, suffix sorting and packing are no SQL; tests run the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
