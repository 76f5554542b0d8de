"""Streams: latest run records, evaluations to resume, markers once, usage by the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.benchmark import latest_records
from ..operators.judge import resume
from .state import VersionedState


def records_of(spark: SparkSession, state: str, order: list[str]) -> VersionedState:
    return VersionedState(spark, state, ("model", "case_id"), lambda rows: latest_records(rows, order))


def upsert_records(stream: DataFrame, state: str, checkpoint: str, plan: DataFrame, order: list[str]) -> StreamingQuery:
    """Keep the last record of each (model, case_id) under ``state``, in versions; records that are not in the plan are left out.

    A batch that comes again changes nothing. A commit rewrites the buckets that its records touch, and a read sees one version, whatever the number of batches.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = batch.join(plan.select("model", "case_id").distinct(), ["model", "case_id"], "left_semi").select(*batch.columns)
        records_of(batch.sparkSession, state, order).commit(batch_id, known)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records_state(spark: SparkSession, state: str, order: list[str]) -> DataFrame | None:
    """The last record of each key; None before the first commit."""
    return records_of(spark, state, order).rows()


def pending_evaluations(stream: DataFrame, done: DataFrame, force: list[str] | None = None) -> DataFrame:
    """Reviews of the stream that have no evaluation without errors; forced tools come anew."""
    return resume(stream, done, force)


def publish_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each marker once, while its repetitions come within the delay of one another (column ts)."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["marker"])


def hourly_usage(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Usage by hour and stage; the measures are those of ``call_usage``."""
    w = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "stage")
    out = w.agg(F.count("*").alias("calls"), F.count("input_tokens").alias("reporting"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"), F.count("error").alias("errors"))
    return out.select(F.col("window.start").alias("hour"), "stage", "calls", "reporting", "tokens", "errors")
