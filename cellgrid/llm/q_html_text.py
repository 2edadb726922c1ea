"""Query of operator 13: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.html_text import extract

NAME = "op13_html_text"
SQL = None  # reading markup is no SQL; tests compare with pages whose article is known


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
