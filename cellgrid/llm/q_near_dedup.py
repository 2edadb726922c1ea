"""Query of operator 10: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.common import documents
from cellgrid.llm.near_dedup import near_duplicates

NAME = "op10_minhash_near_dedup"
SQL = None  # hashed signatures are no SQL; tests compare with all pairs of a small fixture


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
