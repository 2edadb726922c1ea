"""Query of operator 8: packs all documents into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.common import documents
from cellgrid.llm.packing import pack_documents

NAME = "op8_best_fit_packing"
SQL = None  # tokens and packing are no SQL; tests compare with the tokenizer library and check every sequence


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
