"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of any other characters.
SPACE = "\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
TRIMMED = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For str.translate: A-Z lower-cased, all else as it is.
ASCII_LOWER = {ord(a): ord(b) for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(folder)
    return folder


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the place of the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there and outlives a lost executor."""
    return stored_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pd.Series], rows: int = 256) -> Iterator[pd.Series]:
    """The batches in parts of so many rows, so that a worker holds the results of few texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of docs as one struct ``_row`` beside the columns in extra, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in extra.items()])


def replaced(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of ``_row``; those in new are replaced."""
    return df.select(*[(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c)) for c in docs.columns])


def firsts(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the component_id of linked (doc_id, component_id), and those without doc_id.

    Of rows that share a doc_id the one with the least text stays.
    """
    first = linked.where("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    rows = packed(docs, _id=F.col("doc_id"), _text=F.col("text"))
    kept = rows.join(first, "_id", "left_semi").groupBy("_id").agg(F.min_by("_row", F.struct(F.coalesce("_text", F.lit("")), F.xxhash64("_row"))).alias("_row"))
    return replaced(kept.select("_row").unionByName(rows.where("_id is null").select("_row")), docs)
