"""Golden issues against candidates: pairs, verdicts, running best, precision, recall and F1."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["golden_url", "tool"]


def candidates_or_comments(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """(golden_url, tool, candidate_index, text) for each review (golden_url, tool, comments).

    Exported candidates (golden_url, tool, texts) win, even an empty list; else the review's own comments. Empty ones drop out.
    """
    both = reviews.join(candidates, KEY, "left").select(*KEY, F.coalesce("texts", "comments").alias("t"))
    kept = F.filter("t", lambda x: x.isNotNull() & (x != ""))
    return both.select(*KEY, F.posexplode(kept).alias("candidate_index", "text"))


def pairs(golden: DataFrame, candidates: DataFrame) -> DataFrame:
    """All pairs of a case and tool, golden issue first. Never across cases: the join is on golden_url.

    golden: (golden_url, golden_index, comment, severity); candidates: (golden_url, tool, candidate_index, text).
    """
    sizes = candidates.groupBy(*KEY).agg(F.count("*").alias("n_candidates"))
    # the sizes meet candidates before pairs are made, and a case's candidates are dealt out by their index, so that no task makes all pairs of a case
    dealt = candidates.join(sizes, KEY).repartition(*KEY, "candidate_index")
    both = golden.join(dealt, "golden_url")
    return both.withColumn("pair_seq", F.col("golden_index").cast("long") * F.col("n_candidates") + F.col("candidate_index"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the distinct words of a text, so that they are made once and not for each pair."""
    return df.withColumn(out, _tokens(F.col(text)))


def jaccard(x: Column, y: Column) -> Column:
    """Overlap of two lists of distinct words."""
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def score_pairs(pair_table: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None, threshold: float = 0.3) -> DataFrame:
    """pairs with match, confidence and error. A scorer maps frames (comment, text) to (match, confidence, error).

    Each distinct pair of texts is scored once. Without a scorer, the overlap of words (columns comment_words and text_words
    of ``with_words``) decides. What a scorer raises is an error of its rows.
    """
    if scorer is None:
        c = jaccard(F.col("comment_words"), F.col("text_words"))
        return pair_table.withColumn("confidence", c).withColumn("match", F.col("confidence") >= threshold).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = scorer(batch[["comment", "text"]]).reset_index(drop=True)
            except Exception as e:  # errors are data
                found = pd.DataFrame({"match": [None] * len(batch), "confidence": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.concat([batch[["_pair"]].reset_index(drop=True), found[["match", "confidence", "error"]]], axis=1)

    # verdicts meet pairs by a digest of both texts, so that pairs are dealt out without their texts where nobody asks for these; SHA-256, as texts of one MD5 are known
    keyed = pair_table.withColumn("_pair", F.unhex(F.sha2(F.concat(F.sha2("comment", 256), F.sha2("text", 256)), 256)))
    scored = keyed.select("_pair", "comment", "text").distinct().mapInPandas(run, "_pair binary, match boolean, confidence double, error string")
    return keyed.join(scored, "_pair", "left").drop("_pair")


def running_best(verdicts: DataFrame) -> DataFrame:
    """verdicts with improves: the match's confidence is above all before it for the same golden text."""
    sound = F.when(F.col("match") & F.col("error").isNull(), F.col("confidence"))
    w = Window.partitionBy(*KEY, "comment").orderBy("pair_seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(sound).over(w), F.lit(0.0))
    return verdicts.withColumn("improves", F.coalesce(sound > before, F.lit(False)))


def siblings(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(golden_url, tool, text, sibling): other texts of the last group that a text is in; indexes out of range are left out."""
    members = groups.join(candidates, [*KEY, "candidate_index"]).select(*KEY, "group_index", "text").distinct()
    last = members.groupBy(*KEY, "text").agg(F.max("group_index").alias("group_index"))
    other = members.select(*KEY, "group_index", F.col("text").alias("sibling"))
    return last.join(other, [*KEY, "group_index"]).where("text <> sibling").select(*KEY, "text", "sibling")


def evaluate(golden: DataFrame, candidates: DataFrame, verdicts: DataFrame, reviews: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(golden_url, tool, skipped, tp, fp, fn, errors_count, total_candidates, total_golden, precision, recall) for each review.

    Golden texts and candidate texts that repeat count once in tp, fn and fp, each time in the totals; where there are no candidates, fn is all of the golden
    comments, each time.
    """
    # pairs that are no match change no maximum
    hit = running_best(verdicts.where("match and error is null")).where("improves")
    hits = hit.groupBy(*KEY).agg(F.count_distinct("comment").alias("tp"), F.count_distinct("text").alias("matched"))
    if groups is not None:
        matched = hit.select(*KEY, "text").distinct()
        more = matched.join(siblings(candidates, groups), [*KEY, "text"]).select(*KEY, F.col("sibling").alias("text"))
        hits = hits.drop("matched").join(matched.unionByName(more).distinct().groupBy(*KEY).agg(F.count("*").alias("matched")), KEY)
    n_candidates = candidates.groupBy(*KEY).agg(F.count("*").alias("total_candidates"), F.count_distinct("text").alias("texts"))
    n_golden = golden.groupBy("golden_url").agg(F.count("*").alias("total_golden"), F.count_distinct("comment").alias("comments"))
    errors = verdicts.where("error is not null").groupBy(*KEY).agg(F.count("*").alias("errors_count"))
    out = reviews.select(*KEY).distinct().join(n_golden, "golden_url", "left")
    for df in (n_candidates, hits, errors):
        out = out.join(df, KEY, "left")
    out = out.na.fill(0, ["total_golden", "comments", "total_candidates", "texts", "tp", "matched", "errors_count"])
    ratio = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(0.0)
    return out.select(
        *KEY, (F.col("total_golden") == 0).alias("skipped"), "tp", F.when(F.col("total_golden") > 0, F.col("texts") - F.col("matched")).otherwise(0).alias("fp"), F.when(F.col("total_candidates") == 0, F.col("total_golden")).otherwise(F.col("comments") - F.col("tp")).alias("fn"),
        "errors_count", "total_candidates", "total_golden", ratio("total_candidates").alias("precision"), ratio("total_golden").alias("recall"),
    )


def _rates(df: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    df = df.withColumn("precision", over("tp", "fp")).withColumn("recall", over("tp", "fn"))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def metrics(evaluations: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    """Sums and rates by tool, or by the columns in by (all levels of them with rollup); skipped reviews do not count."""
    rows = evaluations.where("not skipped")
    grouped = rows.rollup(*(by or ("tool",))) if rollup else rows.groupBy(*(by or ("tool",)))
    return _rates(grouped.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum("errors_count").alias("errors"), F.count("*").alias("reviews")))


def paired_deltas(evaluations: DataFrame, a: str, b: str, score: str = "recall") -> DataFrame:
    """Mean and spread of b's score less a's over the cases that both have."""
    of = lambda tool, name: evaluations.where((F.col("tool") == tool) & ~F.col("skipped")).select("golden_url", F.col(score).alias(name))
    d = of(a, "x").join(of(b, "y"), "golden_url").withColumn("d", F.col("y") - F.col("x"))
    return d.agg(F.count("*").alias("cases"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("sd_delta"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"))


def resume(reviews: DataFrame, done: DataFrame, force: list[str] | None = None) -> DataFrame:
    """Reviews still to evaluate: those done without errors drop out, but for forced tools."""
    sound = done.where("errors_count = 0")
    if force:
        sound = sound.where(~F.col("tool").isin(force))
    return reviews.join(sound.select(*KEY).distinct(), KEY, "left_anti")


def work_queue(pair_counts: DataFrame) -> DataFrame:
    """Largest number of comparisons first, then case and tool."""
    return pair_counts.orderBy(F.desc("n_pairs"), "golden_url", "tool")
