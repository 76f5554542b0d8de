"""op4: language of every document, learned from three of four folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, lang_id


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = lang_id.held_out(F.col("doc_id"))
    out = lang_id.predicted(docs, lang_id.train(docs.where(~held)))
    return out.select(F.col("_row.doc_id").alias("doc_id"), lang_id.held_out(F.col("_row.doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_lang_id": op4_lang_id}
ORACLE: dict[str, str] = {}
