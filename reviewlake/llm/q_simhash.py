"""op8: fingerprints of all documents and the components of those within 3 bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simhash


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.linked(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
