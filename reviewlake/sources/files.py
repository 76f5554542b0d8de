"""Readers of benchmark data, artifacts, judge bundles and repositories; writers of bundles and records."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.paths import bench_pr_url, strict_path


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset, a folder of our own on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(folder)
    return folder


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """golden, bench_reviews and the quarantine (golden_url, reason) of files with one JSON object keyed by golden address."""
    whole = spark.read.text(path, wholetext=True).select("value")
    entries = whole.select(F.explode(F.from_json("value", f"map<string,struct<{schemas.BENCH_ENTRY.replace(', ', ',')}>>")).alias("golden_url", "e"))
    blank = F.exists("e.golden_comments", lambda x: x["comment"].isNull() | (F.trim(x["comment"]) == ""))
    reason = (
        F.when(bench_pr_url(F.col("golden_url")).isNull(), "not a pull request's address").when(F.coalesce(F.size("e.golden_comments"), F.lit(0)) <= 0, "no golden comments").when(blank, "empty golden comment")
    )
    entries = entries.withColumn("reason", reason)
    good = entries.where("reason is null")
    golden = good.select("golden_url", F.posexplode("e.golden_comments").alias("golden_index", "c")).select("golden_url", "golden_index", "c.*")
    reviews = good.select("golden_url", F.explode("e.reviews").alias("r")).select("golden_url", "r.*")
    return golden, reviews, entries.where("reason is not null").select("golden_url", "reason")


def read_artifacts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row for each artifact file, with the file's path; what has not the shape is null in schema_version."""
    return spark.read.schema(schemas.ARTIFACT).option("multiLine", True).json(paths).withColumn("artifact", F.col("_metadata.file_path"))


def exploded(artifacts: DataFrame, column: str) -> DataFrame:
    """Rows of one list (findings, rejected or calls) with model, case and place."""
    return artifacts.select(F.col("config.model").alias("model"), F.col("benchmark.case_id").alias("case_id"), F.posexplode_outer(column).alias("seq", "x")).select("model", "case_id", "seq", "x.*")


def read_nested(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(golden_url, tool, value) of a JSON object of objects; value is the type of what it holds."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,map<string,{value}>>")).alias("golden_url", "m")).select("golden_url", F.explode("m").alias("tool", "value"))


def read_repo_files(spark: SparkSession, path: str, root: str, commit_sha: str, cap: int = 2_000_000) -> DataFrame:
    """(commit_sha, path, blob_sha, content) of text files under root: safe paths, at most cap bytes, no NUL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= cap)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(F.lit("^"), F.lit(re.sub("^file:/*", "/", root).rstrip("/") + "/")), F.lit(""))
    rows = files.select(F.lit(commit_sha).alias("commit_sha"), relative.alias("path"), F.sha1("content").alias("blob_sha"), "content").where(~F.contains("content", F.lit(b"\0")))
    return rows.where(strict_path(F.col("path"))).withColumn("content", F.decode("content", "UTF-8"))


def write_bundle(df: DataFrame, path: str) -> None:
    """Flat Parquet by tool."""
    df.write.partitionBy("tool").mode("overwrite").parquet(path)


def nested_json(df: DataFrame, value: str) -> DataFrame:
    """One JSON object for each golden address: tool to value. df: (golden_url, tool, value)."""
    by_tool = df.groupBy("golden_url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", value)))).alias("m"))
    return by_tool.select("golden_url", F.to_json("m").alias("json"))


def write_records(df: DataFrame, path: str) -> None:
    """Records by model; only the partitions that df has are replaced."""
    df.write.partitionBy("model").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
