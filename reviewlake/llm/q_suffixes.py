"""op5: passages of 50 words and more that repeat across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, suffixes


def op5_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.spans(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_spans": op5_suffix_spans}
ORACLE: dict[str, str] = {}
