"""Query of operator 9: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.common import documents
from cellgrid.llm.fingerprints import edited_fingerprints

NAME = "op9_fingerprints"
SQL = None  # the lanes come from a 64-bit hash that the SQL side lacks; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
