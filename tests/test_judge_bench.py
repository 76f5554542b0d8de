import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import benchmark, export, judge
from reviewlake.plans import jobs

G = "golden_url string, golden_index int, comment string, severity string"
C = "golden_url string, tool string, candidate_index int, text string"


def table(spark, confidences):
    """Verdicts of golden a against candidates in order; None is no match."""
    rows = [("u", "t", "a", i, c is not None, float(c or 0), None, i, f"c{i}") for i, c in enumerate(confidences)]
    return spark.createDataFrame(rows, "golden_url string, tool string, comment string, candidate_index int, match boolean, confidence double, error string, pair_seq long, text string")


def test_every_rise_of_the_maximum_counts(spark):
    got = {r.candidate_index for r in judge.running_best(table(spark, [0.5, 0.5, 0.9, None, 0.7, 0.0])).where("improves").collect()}
    assert got == {0, 2}


def test_groups_share_a_match(spark):
    golden = spark.createDataFrame([("u", 0, "a", "high"), ("u", 1, "b", "low")], G)
    cands = spark.createDataFrame([("u", "t", i, f"c{i}") for i in range(3)], C)
    groups = spark.createDataFrame([("u", "t", 0, 0), ("u", "t", 0, 1), ("u", "t", 1, 2), ("u", "t", 1, 9)], "golden_url string, tool string, group_index int, candidate_index int")
    v = judge.pairs(golden, cands).withColumn("match", F.expr("comment = 'a' and candidate_index = 1")).withColumn("confidence", F.lit(0.9)).withColumn("error", F.lit(None).cast("string"))
    e = judge.evaluate(golden, cands, v, cands.select("golden_url", "tool"), groups).first()
    assert (e.tp, e.fp, e.fn) == (1, 1, 1) and e.precision == pytest.approx(1 / 3) and e.recall == 0.5
    m = judge.metrics(judge.evaluate(golden, cands, v, cands.select("golden_url", "tool"), groups)).first()
    assert (m.precision, m.recall, m.f1, m.reviews) == (0.5, 0.5, 0.5, 1)


def test_clean_reviews_and_cases_without_golden(spark):
    golden = spark.createDataFrame([("u", 0, "a", "high")], G)
    reviews = spark.createDataFrame([("u", "t", []), ("v", "t", ["x"])], "golden_url string, tool string, comments array<string>")
    out = jobs.run_judge(golden, reviews, spark.createDataFrame([], "golden_url string, tool string, texts array<string>"))
    got = {r.golden_url: r for r in out["evaluations"].collect()}
    assert (got["u"].tp, got["u"].fn, got["u"].skipped) == (0, 1, False) and got["v"].skipped and got["v"].fp == 0


def test_scorer_errors_are_data_and_texts_are_scored_once(spark):
    golden = spark.createDataFrame([("u", 0, "a", "high")], G)
    reviews = spark.createDataFrame([("u", "t", ["x", "x"]), ("u", "s", ["x"])], "golden_url string, tool string, comments array<string>")
    none = spark.createDataFrame([], "golden_url string, tool string, texts array<string>")

    def good(df):
        assert not df.duplicated(["comment", "text"]).any()
        return pd.DataFrame({"match": [True] * len(df), "confidence": 0.8, "error": None})

    def bad(df):
        raise RuntimeError("no")

    assert {r.tool: (r.tp, r.fp, r.total_candidates) for r in jobs.run_judge(golden, reviews, none, scorer=good)["evaluations"].collect()} == {"t": (1, 0, 2), "s": (1, 0, 1)}
    assert {r.tool: r.errors_count for r in jobs.run_judge(golden, reviews, none, scorer=bad)["evaluations"].collect()} == {"t": 2, "s": 1}


def test_resume_and_force(spark):
    reviews = spark.createDataFrame([("u", "t"), ("v", "t"), ("u", "s")], "golden_url string, tool string")
    done = spark.createDataFrame([("u", "t", 0), ("v", "t", 1), ("u", "s", 0)], "golden_url string, tool string, errors_count int")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(judge.resume(reviews, done)) == {("v", "t")} and rows(judge.resume(reviews, done, ["s"])) == {("v", "t"), ("u", "s")}


def test_plan_and_resume_jobs(spark):
    url = "https://github.com/o/r/pull/7"
    golden = spark.createDataFrame([(url, 0, "a", "high", "bug")], "golden_url string, golden_index int, comment string, severity string, category string")
    reviews = spark.createDataFrame([(url, "zed", "p1", "r1"), (url, "abe", "p2", "r2")], "golden_url string, tool string, pr_url string, repo_name string")
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    plan = jobs.plan_benchmark(golden, reviews, models, spark.createDataFrame([], "model string, case_id string, status string"), ["model", "case_id"])
    case = plan["cases"].first()
    assert case.fixture_tool == "abe" and case.case_id.startswith("o-r-pr7-") and plan["jobs"].count() == 2
    done = spark.createDataFrame([("m1", case.case_id, "completed"), ("m2", case.case_id, "failed")], "model string, case_id string, status string")
    again = jobs.plan_benchmark(golden, reviews, models, done, ["model", "case_id"], preferred="zed")
    assert [r.model for r in again["jobs"].collect()] == ["m2"] and again["cases"].first().fixture_tool == "zed"


def test_clean_review_stays_in_the_export(spark):
    reviews = spark.createDataFrame([("r1", "u", "t"), ("r2", "v", "t")], "review_id string, golden_url string, tool string")
    found = spark.createDataFrame([("r1", "b.py", 2, 2, "RIGHT", "id2", "T2", "body", None, None, "body", ""), ("r1", "a.py", 9, 11, "left", "id1", "T1", "", "tr", "im", "ev", "fx")], "review_id string, path string, line int, end_line int, side string, finding_id string, title string, body string, trigger string, impact string, evidence string, suggested_fix string")
    out = {r.golden_url: r.candidates for r in export.export_candidates(reviews, found).collect()}
    assert out["v"] == [] and [c.text for c in out["u"]] == ["Location: a.py:9-11 (LEFT)\n\nT1\n\nTrigger: tr\n\nImpact: im\n\nEvidence: ev\n\nSuggested fix: fx", "Location: b.py:2 (RIGHT)\n\nT2\n\nbody"]
    bundle = export.export_candidates(reviews, found)
    rows = export.explode_candidates(bundle)
    assert jobs.verify_bundle(bundle, rows, export.singleton_groups(rows)).count() == 0
    assert jobs.verify_bundle(bundle, rows.withColumn("text", F.upper("text")), export.singleton_groups(rows)).first().reason == "texts differ"


def test_publish_once_per_snapshot(spark):
    reviews = spark.createDataFrame([("r", "b", "h"), ("s", "b", "old")], "review_id string, base_sha string, head_sha string")
    found = spark.createDataFrame([("r", "f2"), ("r", "f1"), ("s", "f3")], "review_id string, finding_id string")
    now = spark.createDataFrame([("r", "b", "h"), ("s", "b", "new")], "review_id string, base_sha string, head_sha string")
    first = export.to_publish(reviews, found, now, spark.createDataFrame([], "marker string"))
    assert [r.review_id for r in first.collect()] == ["r"] and export.to_publish(reviews, found, now, first.select("marker")).count() == 0


def test_mixed_snapshots_are_not_comparable(spark):
    rows = [("m1", "c", "g", "r", "b", "h", "d"), ("m2", "c", "g", "r", "b", "h2", "d"), ("m1", "k", "g", "r", "b", "h", "d")]
    got = benchmark.sweep_violations(spark.createDataFrame(rows, "model string, case_id string, golden_url string, review_url string, base_sha string, head_sha string, diff_sha256 string"))
    assert {(r.case_id, r.reason) for r in got.collect()} == {("c", "snapshots differ"), ("k", "case is missing for a model")}
