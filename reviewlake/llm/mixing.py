"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each document waits in the queue of its source, shuffled, and finishes at a virtual time: the tokens
of its source up to and with it, divided by the source's target. All queues are served in order of
finish, until the next document would exceed the total budget. A source whose target is
above its own tokens is queued again, up to ``EPOCHS`` times, each time in another order.

Work: every document is reduced to (key, size, source) in one pass over the texts. Sums in order
(of sources, within sources and in the mix) are taken in two levels: rows are dealt out in
ranges, each range is summed, and a row adds the sums of the ranges before its own. A source with a third
of all rows is many ranges, and no task sees a source whole.

Defined cases: a null or empty text has no tokens, is never taken and counts for nothing; documents without
source are a source of their own, last in order; rows that repeat are queued each, and
count each; a row without doc_id is shuffled by its text; rows of one key are queued by size, and those
alike in both, which no column of the result tells apart, in any order; an empty table gives no
rows; other columns, whatever their names, are not read; a long text counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Most copies of a document in a mix.
EPOCHS = 3
#: Sources weigh 1, 2, 3 in order of name, repeating.
WEIGHTS = (1, 2, 3)
BIG = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Number of words, without a list of them: each becomes one letter, then blanks go."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, common.WORD, "w"), common.TRIMMED, "")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """df with sums {new column: column}: of all rows up to and with each one, in the order given.

    The number of ranges is the session's number of shuffle partitions.
    """
    dealt = common.stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    whole = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    # a row for each range: their number is that of shuffle partitions
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_own_{n}": F.sum(c).over(within) for n, c in sums.items()}).join(starts, "_range")
    return rows.select(*df.columns, *[(F.col(f"_start_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums])


def narrowed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, key, size) of each row of docs."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    rows = docs.select("doc_id", "source", F.left(key, F.lit(16)).alias("key"), tokens(F.col("text")).alias("size"))
    return common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix_documents")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, no_source, nth, source_size, copies, target) of each source of rows (source, size).

    Weights share all tokens; a target above ``epochs`` times the source's tokens stops there, and what it leaves is shared anew. Sources by how
    soon they reach their limit: one is limited if its share of what those before leave is above its own limit.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no_source", F.col("source").isNull()).withColumn("one", F.lit(1))
    named = running(sums, ["no_source", "source"], {"nth": "one"}, "mix_sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    # a limit by weight, in whole numbers: all weights divide their product
    product = 1
    for w in weights:
        product *= w
    known = named.withColumn("weight", weight.cast(BIG)).withColumn("limit", (F.col("source_size") * epochs).cast(BIG)).withColumn("soon", (F.col("source_size") * F.lit(product) / F.col("weight")).cast(BIG))
    total = known.agg(F.sum("limit").alias("l"), F.sum("weight").alias("w")).select((F.col("l") / epochs).cast(BIG).alias("all_tokens"), F.col("w").alias("all_weights"))
    ranked = running(known, ["soon", "no_source", "source"], {"limits": "limit", "weights": "weight"}, "mix_limits").crossJoin(F.broadcast(total))  # one row
    left, open_weights = F.col("all_tokens") - (F.col("limits") - F.col("limit")), F.col("all_weights") - (F.col("weights") - F.col("weight"))
    ranked = common.stored(ranked.withColumn("limited", F.col("limit") * open_weights <= F.col("weight") * left), "mix_ranked")
    spent = ranked.where("limited").agg(F.coalesce(F.sum("limit"), F.lit(0)).alias("spent"), F.coalesce(F.sum("weight"), F.lit(0)).alias("spent_weights"))
    shared = F.col("weight").cast("double") * (F.col("all_tokens") - F.col("spent")).cast("double") / (F.col("all_weights") - F.col("spent_weights")).cast("double")
    target = F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(shared)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.ceil(F.col("target") / F.col("source_size")))).otherwise(0)
    out = ranked.crossJoin(F.broadcast(spent)).withColumn("target", target).withColumn("copies", copies.cast("int"))  # one row
    return common.stored(out.select("source", "no_source", "nth", "source_size", "copies", "target"), "mix_targets")


def queued(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(row, size, nth, epoch, turn, finish): each document with tokens as often as its source is queued, with its virtual finish time."""
    sized = rows.where("size > 0").select("row", "key", "size", F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("no_source"))
    known = goals.where("copies > 0").select(F.coalesce("source", F.lit("")).alias("_name"), "no_source", "nth", "copies", "source_size", "target")
    copies = sized.join(known, ["_name", "no_source"]).select("row", "key", "size", "nth", "source_size", "target", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    turn = F.left(F.md5(F.concat("key", F.lit(":"), F.col("epoch").cast("string"))), F.lit(16))
    ordered = running(copies.withColumn("turn", turn).drop("key"), ["nth", "epoch", "turn", "size"], {"upto": "size"}, "mix_queues")
    # what the queues of earlier sources hold
    before = running(goals.select("nth", (F.col("copies") * F.col("source_size")).alias("queue")), ["nth"], {"queues": "queue"}, "mix_starts").select("nth", (F.col("queues") - F.col("queue")).alias("before"))
    served = F.col("upto") - F.col("before")
    return ordered.join(before, "nth").select("row", "size", "nth", "epoch", "turn", (served.cast("double") / F.col("target")).alias("finish"))


def served(copies: DataFrame, budget: int) -> DataFrame:
    """copies in order of finish with place (tokens of the mix up to and with each), as far as the budget goes."""
    return running(copies, ["finish", "nth", "turn", "size"], {"place": "size"}, "mix_order").where(F.col("place") <= budget)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: (row, doc_id, source, epoch, size, finish, place); a trainer reads it in order of place."""
    rows = narrowed(docs)
    goals = targets(rows)
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return served(queued(rows, goals), budget).join(rows.select("row", "doc_id", "source"), "row").select("row", "doc_id", "source", "epoch", "size", "finish", "place")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies_taken) of each row of docs."""
    rows = narrowed(docs)
    goals = targets(rows)
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    used = served(queued(rows, goals), budget).groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").alias("copies_taken"))
    known = goals.select(F.coalesce("source", F.lit("")).alias("_name"), "no_source", "source_size", "target")
    out = rows.withColumn("_name", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull()).join(known, ["_name", "no_source"]).join(used, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies_taken", F.lit(0)).alias("copies_taken"))
