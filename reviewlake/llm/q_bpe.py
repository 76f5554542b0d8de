"""op3: token ids of every document and the text decoded from them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

#: Where the vocabulary file lies; a parameter of the operator.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    out = bpe.round_trip(docs, path)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encoded_rows(out: DataFrame) -> DataFrame:
    """What ``bpe.round_trip`` gives, with digests in place of the decoded text."""
    row = F.col("_row")
    return out.select(row.doc_id.alias("doc_id"), row.source.alias("source"), row.lang.alias("lang"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
