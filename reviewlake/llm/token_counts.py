"""Token counts as rollups that signed changes keep up to date.

``Rollup`` keeps, under one folder:

* ``ledger/batch=N`` - the changes of batch N: one row (doc_id, source, lang, version, sign,
  n_tokens) for each count that comes (+1) or goes (-1); a revised count is both;
* ``totals/batch=N`` - the sums of batch N by source, language and tokenizer version.

A batch is committed by overwriting its two folders and then writing ``commits/batch=N``;
a batch that is committed already changes nothing, and one that failed halfway is written
anew. Totals are sums over the committed batches, so batches may come in any order, and
each batch's rows are summed before they are shuffled to their key.

Counts are taken where the texts lie; only sums by key are shuffled. Defined cases: a null
text counts 0 tokens and is still a document; null source or lang is its own key; repeated
rows count each; an empty batch commits no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ("source", "lang", "version")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHANGES = "doc_id long, source string, lang string, version string, sign int, n_tokens long"


_ENCODINGS: dict[str, object] = {}


def _encoding(version: str, ranks: dict[bytes, int]):
    """One for each worker and version."""
    import tiktoken

    if version not in _ENCODINGS:
        _ENCODINGS[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[version]


def count_column(text: Column, version: str, path: str) -> Column:
    """Tokens of each text by the rank file at path; the driver reads it and broadcasts its ranks (of a fixed number)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    shared = SparkSession.active().sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(version, shared.value).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t or "")) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def counted(docs: DataFrame, version: str, path: str, sign: int = 1) -> DataFrame:
    """The change that these documents are: +1 to insert them, -1 to delete them as they were."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"), F.lit(sign).cast("int").alias("sign"), count_column(F.col("text"), version, path).alias("n_tokens"),
    )


def estimated(docs: DataFrame, version: str) -> DataFrame:
    """As ``counted``, with the number of words in place of tokens, until those are counted."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), f"[{common.SPACE}]+"), lambda w: w != ""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), F.lit(1).alias("sign"), n.cast("long").alias("n_tokens")
    )


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))


@dataclass
class Rollup:
    spark: SparkSession
    path: str

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self, batch: int) -> bool:
        return self._exists(f"commits/batch={batch}/_SUCCESS")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply the changes once; False if the batch was committed before."""
        if self.committed(batch):
            return False
        ledger = f"{self.path}/ledger/batch={batch}"
        changes.write.mode("overwrite").parquet(ledger)
        # the sums are those of what the ledger holds, whatever a second reading of the input would give
        summed(self.spark.read.schema(CHANGES).parquet(ledger)).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def _read(self, name: str) -> DataFrame:
        done = self.spark.read.parquet(f"{self.path}/commits").select("batch").distinct()
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys without documents are gone."""
        return self._read("totals").groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def current(self) -> DataFrame:
        """The count that holds for each document and version."""
        return self._read("ledger").groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("held")).where("held > 0")

    def revision(self, new: DataFrame) -> DataFrame:
        """Changes that put new counts (rows of ``counted``) in place of those that hold for the same document and version."""
        ids = new.select("doc_id", "version").distinct()
        old = self.current().join(ids, ["doc_id", "version"], "left_semi")
        gone = old.select("doc_id", *KEYS, (-F.col("held")).cast("int").alias("sign"), "n_tokens")
        return gone.unionByName(new)

    def deletion(self, doc_ids: DataFrame) -> DataFrame:
        """Changes that take the documents out, for all versions."""
        old = self.current().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return old.select("doc_id", *KEYS, (-F.col("held")).cast("int").alias("sign"), "n_tokens")


def rollup(spark: SparkSession, name: str) -> Rollup:
    return Rollup(spark, f"{common.shared_folder(spark)}/{name}")
