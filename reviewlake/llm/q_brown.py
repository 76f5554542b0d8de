"""op9: base and class-bigram scores of every document, learned from six of seven folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, common


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = brown.train(docs.where(~brown.held_out(F.col("doc_id"))))
    return brown.scored(docs, model).select("doc_id", brown.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_brown_lm": op9_brown_lm}
ORACLE: dict[str, str] = {}
