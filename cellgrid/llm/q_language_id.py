"""Query of operator 3: the language of all documents, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm import language_id as li
from cellgrid.llm.common import documents

NAME = "op3_language_id"
SQL = None  # code lengths are no SQL; tests compare with a brute-force coder and measure held-out accuracy


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = li.train(docs, ~li.held_out())
    return li.predict(spark, docs, model).select("doc_id", li.held_out().alias("held_out"), "lang_pred", "score")
