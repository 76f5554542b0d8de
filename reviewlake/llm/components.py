"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds after which something must be wrong.
ROUNDS = 500


def _least(edges: DataFrame) -> DataFrame:
    """For each u: the least of itself and its neighbours v."""
    return edges.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == F.col("_u"))
    to_least = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return to_least.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of an edge: label is the least node that can be reached.

    No neighbourhood is gathered: each round is joins and least values, whatever a node's
    degree. Each round ends in the shared folder, where it takes the place of the one before. The rounds end when the
    edges stay; their number grows with the logarithm of the longest path, and ``ROUNDS`` is far beyond it.
    """
    spark = edges.sparkSession
    now, path = common.stored_at(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        seen, before = state, path
        now, path = common.stored_at(_small_star(_large_star(now)), "edges")
        common.remove(spark, before)
    raise RuntimeError("components do not settle")
