"""Query of operator 2: byte-level BPE of all documents and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.byte_bpe import digest
from cellgrid.llm.common import documents

NAME = "op2_byte_bpe"
SQL = None  # merges by rank are no SQL; tests compare with the tokenizer library


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
