"""Coverage, status, usage, context and run telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import first_number


def hunk_coverage(hunks: DataFrame, chunk_hunks: DataFrame, done: DataFrame) -> DataFrame:
    """(review_id, eligible_hunks, completed_hunks, failed_hunks, complete, coverage_ratio).

    hunks: eligible (review_id, hunk_id) and, with a null hunk_id, reviews without any; chunk_hunks: (review_id, chunk_id, hunk_id);
    done: (review_id, chunk_id) completed. A hunk is complete if it has chunks and all are; no eligible hunk is full coverage.
    """
    marked = chunk_hunks.join(done.select("review_id", "chunk_id").distinct().withColumn("_done", F.lit(True)), ["review_id", "chunk_id"], "left")
    per = marked.groupBy("review_id", "hunk_id").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("complete"))
    rows = hunks.join(per, ["review_id", "hunk_id"], "left")
    out = rows.groupBy("review_id").agg(F.count("hunk_id").alias("eligible_hunks"), F.count_if("complete").alias("completed_hunks"))
    out = out.withColumn("failed_hunks", F.col("eligible_hunks") - F.col("completed_hunks")).withColumn("complete", F.col("failed_hunks") == 0)
    return out.withColumn("coverage_ratio", F.when(F.col("eligible_hunks") == 0, 1.0).otherwise(F.col("completed_hunks") / F.greatest("eligible_hunks", F.lit(1))))


def review_status(coverage: DataFrame) -> DataFrame:
    """coverage (with column fatal) with status."""
    status = F.when(F.col("fatal"), "failed").when(F.col("complete"), "completed").when(F.col("completed_hunks") > 0, "partial").otherwise("failed")
    return coverage.withColumn("status", status)


def call_usage(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, calls that report tokens, their sum and those that do not, by stage."""
    tokens = F.col("input_tokens") + F.coalesce("output_tokens", F.lit(0))
    return calls.groupBy(*(by or ("stage",))).agg(
        F.count("*").alias("calls"), F.count("input_tokens").alias("reporting"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        (F.count("*") - F.count("input_tokens")).alias("missing"), F.count("error").alias("errors"),
        F.sum("latency_ms").alias("latency_ms"), F.coalesce(F.sum("cached_input_tokens"), F.lit(0)).alias("cached_tokens"), F.sum("cost_usd").alias("cost_usd"),
    )


def last_usage(events: DataFrame) -> DataFrame:
    """Usage of each call out of its event stream (call_id, seq, payload): the last event that has any counts.

    Providers name the fields differently; the first that is there and a whole number is taken.
    """
    usage = F.get_json_object("payload", "$.usage")
    rows = events.where(usage.isNotNull()).groupBy("call_id").agg(F.max_by(usage, F.col("seq")).alias("u"))
    return rows.select(
        "call_id", first_number(F.col("u"), "$.input_tokens", "$.prompt_tokens").alias("input_tokens"), first_number(F.col("u"), "$.output_tokens", "$.completion_tokens").alias("output_tokens"),
        first_number(F.col("u"), "$.cached_input_tokens", "$.prompt_tokens_details.cached_tokens").alias("cached_input_tokens"),
    )


def latency_quantiles(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*(by or ("stage",))).agg(F.percentile_approx("latency_ms", [0.5, 0.9, 0.99]).alias("latency_ms"))


def context_totals(packets: DataFrame, kinds: list[str]) -> DataFrame:
    """packets (review_id, text, kind, omitted_reason): characters, bytes and estimated tokens, and rows by kind of evidence."""
    sums = packets.groupBy("review_id").agg(
        F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.floor((F.length("text") + 3) / 4)).alias("tokens"), F.count("omitted_reason").alias("omitted"),
        *[F.count_if((F.col("kind") == k) & F.col("omitted_reason").isNull()).alias(k) for k in kinds],
    )
    return sums


def omissions(packets: DataFrame) -> DataFrame:
    return packets.where("omitted_reason is not null").groupBy("review_id", "omitted_reason").agg(F.count("*").alias("n"))


def context_pressure(batches: DataFrame) -> DataFrame:
    """batches (review_id, used, budget, truncated): how near the budgets were."""
    used = F.col("used") / F.greatest("budget", F.lit(1))
    return batches.groupBy("review_id").agg(
        F.count("*").alias("batches"), F.count_if("truncated").alias("truncated_batches"), F.count_if(used >= 0.95).alias("near_limit"), F.max(used).alias("max_utilisation"), F.bool_or("truncated").alias("hit_limit"),
    )


def exposed_file_sets(exposed: DataFrame, changed: DataFrame) -> DataFrame:
    """exposed (review_id, path) against changed (review_id, path): unique, changed, cross-file and omitted files."""
    e, c = exposed.select("review_id", "path").distinct().withColumn("e", F.lit(1)), changed.select("review_id", "path").distinct().withColumn("c", F.lit(1))
    both = e.join(c, ["review_id", "path"], "full")
    return both.groupBy("review_id").agg(
        F.count("e").alias("exposed_files"), F.count_if(F.col("e").isNotNull() & F.col("c").isNotNull()).alias("changed_files"),
        F.count_if(F.col("c").isNull()).alias("cross_files"), F.count_if(F.col("e").isNull()).alias("omitted_files"),
    )


def selection_telemetry(requests: DataFrame) -> DataFrame:
    """requests (review_id, batch_id, action, outcome, lines, hits) summed by batch."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return requests.groupBy("review_id", "batch_id").agg(
        F.count("*").alias("requested"), *[is_(o).alias(o) for o in ("accepted", "rejected", "omitted", "deduplicated")],
        *[F.count_if((F.col("action") == a) & (F.col("outcome") == "accepted")).alias(f"{a}_actions") for a in ("list", "read", "search")],
        F.sum("lines").alias("lines"), F.sum("hits").alias("hits"),
    )


def pages_left(pages: DataFrame) -> DataFrame:
    """pages (review_id, batch_id, path, query, round, seq, more): paginations whose last page says that there is more."""
    last = pages.groupBy("review_id", "batch_id", "path", "query").agg(F.max_by("more", F.struct("round", "seq")).alias("more"))
    return last.groupBy("review_id", "batch_id").agg(F.count_if("more").alias("unresolved"))


def run_status(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("records"))
