"""Query of operator 5: suffix-array dedup over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.common import documents
from cellgrid.llm.suffix_dedup import repeat_report

NAME = "op5_suffix_dedup"
SQL = None  # byte windows of whole tables are too slow in SQL; tests compare with all windows of a small fixture


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(documents(spark, sf_dir))
