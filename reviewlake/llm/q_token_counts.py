"""op6: token totals by source, language and tokenizer version."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_counts

#: Versions and their rank files.
VERSIONS = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by two tokenizers, after all that can happen to a count.

    At first every document, and a copy of each under another id, comes with its number of words as
    an estimate; then its count by the first tokenizer replaces that, the copies go, and
    the counts by the second come. Each batch comes twice and counts once.
    """
    docs = common.table(spark, sf_dir, "documents")
    kept = token_counts.rollup(spark, f"token_counts-{uuid.uuid4().hex}")
    first, second = VERSIONS
    known = docs.where("doc_id is not null")
    copies = known.withColumn("doc_id", -F.col("doc_id") - 1)
    batches = (
        lambda: token_counts.estimated(known.unionByName(copies), first),
        lambda: kept.revision(token_counts.counted(docs, first, VERSIONS[first])),
        lambda: kept.deletion(copies),
        lambda: token_counts.counted(docs, second, VERSIONS[second]),
    )
    for number, changes in enumerate(batches, 1):
        kept.commit(number, changes())
        kept.commit(number, changes())
    return kept.totals()


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
