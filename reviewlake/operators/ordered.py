"""Sums over all rows in a global order, in two levels, so that no task sees a group whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what several results need is made once, and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that is sent to every task.
FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has ``FEW`` rows at most; if not, its joins shuffle, with the same result. The rows are counted, so df is best one that is stored."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def running(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """df with sums {new column: column}: of all rows up to and with each one, in the order given.

    Rows are dealt out in ranges and kept so; each range is summed, and a row adds what the ranges before its own have. Their number is
    that of the session's shuffle partitions, and one row for each is all that a single task sees.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    whole = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_own_{n}": F.sum(c).over(within) for n, c in sums.items()}).join(starts, "_range")
    return rows.select(*df.columns, *[(F.col(f"_start_{n}") + F.coalesce(f"_own_{n}", F.lit(0))).alias(n) for n in sums])
