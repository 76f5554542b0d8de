"""op12: periodic runs of every document, of which one in ten is made periodic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, runs


def periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text); where crc32 of doc_id is a multiple of ten, the words from a place on repeat, by rules that this number fixes. A null doc_id is none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", f"[{common.SPACE}]+"), lambda w: w != "")
    # columns of their own, so that each is computed once for a text and not for each of its words
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    n = F.size("ws")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    rebuilt = F.transform("ws", lambda w, i: F.get("ws", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return rows.select("doc_id", F.when(n > 0, F.array_join(rebuilt, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = periodic(common.table(spark, sf_dir, "documents"))
    out = made.select("doc_id", runs.found(F.col("text")).alias("r"))
    return out.select("doc_id", "r.n_runs", "r.start", "r.length", "r.period", "r.exponent_milli", "r.runs_sha256", F.sha2("r.collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op12_runs": op12_runs}
ORACLE: dict[str, str] = {}
