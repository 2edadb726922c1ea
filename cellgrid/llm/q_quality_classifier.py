"""Query of operator 7: weak-label quality and toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm import quality_classifier as qc
from cellgrid.llm.common import documents

NAME = "op7_quality_classifier"
SQL = None  # expectation-maximisation and fitting are no SQL; tests measure held-out accuracy


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return qc.classify(spark, docs, qc.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
