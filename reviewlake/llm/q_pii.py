"""op7: documents with surrogates in place of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pii


#: Session setting with the key of the surrogates; a run without it is only good for tests.
KEY_SETTING, TEST_KEY = "spark.reviewlake.pii.key", "key of test runs"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replaced(common.table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_entities", F.col("new_text").alias("text"))


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
