"""Export bundles: eligibility, candidates, merging by tool, verification, reports and publishing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.paths import strict_path
from ..functions.text import strip
from .findings import in_ranges, ordered, render_candidate
from .ordered import few, stored

KEY = ["golden_url", "tool"]
#: Texts that a final finding has.
TEXTS = ("title", "body", "trigger", "impact", "evidence", "suggested_fix", "chunk_id")


def eligibility(artifacts: DataFrame, cases: DataFrame, schema_version: str, expected: dict[str, str] | None = None, fixtures: DataFrame | None = None) -> DataFrame:
    """artifacts with reason: the first gate that keeps one out of an export; null passes. A value that is missing fails its gate.

    expected: columns that must have one value, such as tool, tool_version, suite and digests of the dataset. fixtures: the (golden_url,
    review_url, fixture_tool) that a case has, if more than that of its row in cases. Columns pr_url, base_sha, head_sha,
    chunk_plan_complete, config_json, context_json, runtime_json and findings_json are gates where artifacts have them.
    """
    have = set(artifacts.columns)
    known = cases.select(F.col("golden_url").alias("_url"), F.col("case_id").alias("_case"), F.col("golden_sha256").alias("_sha"))
    pairs = (cases if fixtures is None else fixtures).select(F.col("golden_url").alias("_g"), F.col("review_url").alias("_r"), F.col("fixture_tool").alias("_t")).dropna().distinct().withColumn("_fixture", F.lit(True))
    rows = artifacts.join(known, F.col("golden_url") == F.col("_url"), "left")
    rows = rows.join(pairs, (F.col("golden_url") == F.col("_g")) & (F.col("review_url") == F.col("_r")) & (F.col("fixture_tool") == F.col("_t")), "left")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("model", "golden_url")))
    differs = lambda c, v: ~F.col(c).eqNullSafe(v)
    no_object = lambda c: ~F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    sha = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{40,64}$"), F.lit(False))
    gates = [(differs("schema_version", F.lit(schema_version)), "unsupported schema")]
    gates += [(differs(c, F.lit(v)), f"{c} is not the expected one") for c, v in (expected or {}).items()]
    gates += [
        (differs("status", F.lit("completed")), "not completed"), (F.col("_url").isNull(), "unknown case"), (F.col("_n") > 1, "several artifacts for a case"), (differs("golden_sha256", F.col("_sha")), "golden issues have changed"),
        (differs("case_id", F.col("_case")), "case id is not the case's"), (F.col("_fixture").isNull(), "review is not the case's fixture"),
    ]
    gates += [(differs("pr_url", F.col("review_url")), "pull request is not the fixture's")] if "pr_url" in have else []
    gates += [(sha(c), f"{c} is not exact") for c in ("base_sha", "head_sha") if c in have]
    gates += [(~F.coalesce("coverage_complete", F.lit(False)), "coverage is not complete")]
    gates += [(~F.coalesce("chunk_plan_complete", F.lit(False)), "chunk plan is not complete")] if "chunk_plan_complete" in have else []
    gates += [(no_object(f"{c}_json"), f"{c} is missing") for c in ("config", "context", "runtime") if f"{c}_json" in have]
    gates += [(~F.coalesce(F.schema_of_variant(F.try_parse_json("findings_json")).startswith("ARRAY"), F.lit(False)), "findings are missing")] if "findings_json" in have else []
    return rows.withColumn("reason", F.coalesce(*[F.when(bad, why) for bad, why in gates])).drop("_url", "_case", "_sha", "_g", "_r", "_t", "_fixture", "_n")


def one_configuration(artifacts: DataFrame, column: str = "config_json") -> DataFrame:
    """Tools with more than one evaluation configuration."""
    return artifacts.groupBy("tool").agg(F.count_distinct(column).alias("configurations")).where("configurations > 1")


def finding_violations(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Final findings (review_id, finding_id, fingerprint, ...) that must not be exported, with the reason: the first that holds.

    Path, lines and side, changed lines, id and fingerprint, texts, severity and category, confidence; last, whether another finding has the same id, place and text.
    """
    rows = stored(findings, "final_findings")
    place = ["review_id", "side", "path", "line", "end_line"]
    inside = stored(in_ranges(in_ranges(rows.select(*place).distinct(), ranges, "line"), ranges, "end_line").withColumn("_in", F.lit(True)), "inside")
    known = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  what can't be told does not hold
    holds = (
        ("unsafe path", strict_path(F.col("path"))), ("bad lines", (F.col("line") > 0) & (F.col("end_line") >= F.col("line"))), ("bad side", F.col("side").isin("LEFT", "RIGHT")), ("not a changed line", F.col("_in")),
        ("bad id", F.col("finding_id").rlike("^[a-z]{2}-[0-9a-f]{20}$")), ("bad fingerprint", F.col("fingerprint").rlike("^[0-9a-f]{64}$")),
        ("empty text", F.forall(F.array(*TEXTS), lambda x: x.isNotNull() & (strip(x) != ""))), ("unknown severity or category", F.col("severity").isin(*schemas.SEVERITIES) & F.col("category").isin(*schemas.CATEGORIES)),
        ("bad confidence", F.col("confidence").between(0, 1) & ~F.isnan("confidence")),
    )
    checked = rows.join(few(inside), place, "left").withColumn("reason", F.coalesce(*[F.when(~known(c), F.lit(why)) for why, c in holds]))
    # only what holds so far is sought again, among all findings; it has an id and a place
    sound, same = stored(checked.where("reason is null").select(*findings.columns), "sound_findings"), ["review_id", "finding_id", "path", "line"]
    alike = rows.join(few(sound.select(*same).distinct()), same, "left_semi").groupBy(*same, F.sha2(render_candidate(), 256).alias("_text")).agg(F.count("*").alias("_n")).where("_n > 1")
    again = sound.withColumn("_text", F.sha2(render_candidate(), 256)).join(alike, [*same, "_text"]).withColumn("reason", F.lit("duplicate finding"))
    return checked.where("reason is not null").select(*findings.columns, "reason").unionByName(again.select(*findings.columns, "reason"))


def export_candidates(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(golden_url, tool, candidates) for each review (review_id, golden_url, tool): a clean review has an empty list and is there all the same."""
    rows = ordered(findings).select("review_id", F.struct("place", render_candidate().alias("text"), "path", "line", F.lit("finding").alias("source")).alias("c"))
    lists = rows.groupBy("review_id").agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    out = reviews.join(lists, "review_id", "left")
    empty = F.expr("cast(array() as array<struct<place:int,text:string,path:string,line:int,source:string>>)")
    return out.select(*KEY, F.coalesce("candidates", empty).alias("candidates"))


def explode_candidates(bundle: DataFrame) -> DataFrame:
    return bundle.select(*KEY, F.explode("candidates").alias("c")).select(*KEY, F.col("c.place").alias("candidate_index"), "c.text", "c.path", "c.line", "c.source")


def singleton_groups(candidates: DataFrame) -> DataFrame:
    """Each exported candidate is its own dedup group."""
    return candidates.select(*KEY, F.col("candidate_index").alias("group_index"), "candidate_index")


def replace_tool(old: DataFrame, new: DataFrame, tool: str) -> DataFrame:
    """Rows of one tool give way to new ones, also of cases that the new export lacks; other tools stay."""
    return old.where(F.col("tool") != tool).unionByName(new.select(*old.columns))


def merge_prior(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior rows of reviews that are not in current join it."""
    return current.unionByName(prior.join(current.select(*KEY).distinct(), KEY, "left_anti").select(*current.columns))


def bundle_violations(reviews: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(golden_url, tool, reason): empty if reviews (golden_url, tool, texts), candidates and groups say the same."""
    c = candidates.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate_index", "text"))), lambda x: x["text"]).alias("c_texts"))
    members = groups.groupBy(*KEY, "group_index").agg(F.count("*").alias("members"))
    g = members.groupBy(*KEY).agg(F.count("*").alias("groups"), F.max("members").alias("largest"))
    rows = reviews.select(*KEY, "texts").join(c, KEY, "full").join(g, KEY, "full")
    n = F.coalesce(F.size("texts"), F.lit(0))
    reason = (
        F.when(F.col("texts").isNull(), "no review").when((n > 0) & F.col("c_texts").isNull(), "no candidates").when((n > 0) & F.col("groups").isNull(), "no groups")
        .when((n > 0) & (F.col("texts") != F.col("c_texts")), "texts differ").when(F.coalesce("groups", F.lit(0)) != n, "groups differ").when(F.col("largest") > 1, "group is not single")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*KEY, "reason")


def export_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("tool").agg(F.count_distinct("golden_url").alias("reviews"), F.count("*").alias("candidates"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def render_reports(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(review_id, report): a heading with the number of findings, then one block each, in order."""
    block = F.concat(F.lit("## ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit("\n\n"), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("\n\n"), F.col("body"))
    lists = ordered(findings).groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))
    n = F.coalesce(F.size("b"), F.lit(0))
    head = F.concat(F.lit("# Review of "), F.col("url"), F.lit("\n\nFindings: "), F.greatest(n, F.lit(0)).cast("string"))
    return reviews.join(lists, "review_id", "left").select("review_id", F.concat_ws("\n\n", head, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("report"))


def publish_key(review_id: Column, base_sha: Column, head_sha: Column, finding_ids: Column) -> Column:
    """32 digits that are the same for the same findings on the same snapshot."""
    return F.left(F.sha2(F.to_json(F.struct(base_sha.alias("base"), F.array_sort(finding_ids).alias("findings"), head_sha.alias("head"), review_id.alias("review"))), 256), F.lit(32))


def to_publish(reviews: DataFrame, findings: DataFrame, current: DataFrame, markers: DataFrame) -> DataFrame:
    """(review_id, marker) of reviews whose snapshot is still that of the pull request (review_id, base_sha, head_sha) and whose marker is not there yet."""
    ids = findings.groupBy("review_id").agg(F.collect_set("finding_id").alias("ids"))
    fresh = reviews.join(current, ["review_id", "base_sha", "head_sha"], "left_semi").join(ids, "review_id")
    return fresh.select("review_id", publish_key(*[F.col(c) for c in ("review_id", "base_sha", "head_sha", "ids")]).alias("marker")).join(markers, "marker", "left_anti")
