"""Query of operator 6: class-based language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import class_lm as lm
from cellgrid.llm.common import documents

NAME = "op6_class_lm"
SQL = None  # clustering is no SQL; tests recompute the base score by brute force and compare held-out perplexity


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, counts = lm.train(docs.where(~lm.held_out()).select(F.col("text").alias("_text")))
    return lm.score(spark, docs, model, counts).select(
        "doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
