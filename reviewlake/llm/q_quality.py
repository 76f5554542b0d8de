"""op2: base rules and the divergence from language references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = quality.judged(docs, quality.references(docs))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "words_distance")


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
