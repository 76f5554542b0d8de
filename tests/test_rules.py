import math

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import paths, text
from reviewlake.operators import benchmark, diffs, export, findings, judge


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paths_of_requests(spark):
    given = ["a", "a//b/", "./a/./b", ".", "", "./", "/a", "a/..", "..", "a\\b", "a\0", " a ", "..a", "x" * 4_096, "x" * 4_097]
    assert column(spark, given, paths.action_path) == ["a", "a/b", "a/b", "", "", "", None, None, None, None, None, " a ", "..a", "x" * 4_096, None]


def test_addresses_strict_and_loose(spark):
    given = ["https://github.com/o/r/pull/1", " https://github.com/o/r.git/pull/12/files#x\n", "https://github.com/o/./pull/1", "https://github.com/o/../pull/1", "https://github.com/-o/r/pull/1", "https://github.com/o/r/pull/01", "http://github.com/o/r/pull/1", "https://github.com/o/r/issues/1"]
    url = lambda f: column(spark, given, lambda c: f(c).url)
    base = "https://github.com/"
    assert url(paths.parse_pr_url) == [base + "o/r/pull/1", base + "o/r/pull/12", None, None, None, None, None, None]
    assert url(paths.bench_pr_url) == [base + "o/r/pull/1", None, base + "o/./pull/1", base + "o/../pull/1", base + "-o/r/pull/1", base + "o/r/pull/1", None, None]


def test_slugs_have_a_limit(spark):
    assert column(spark, ["A b!", "", "x" * 63 + " yz", "--"], text.slug) == ["a-b", "value", "x" * 63, "value"]
    assert column(spark, ["abc-def"], lambda c: text.slug(c, limit=4)) == ["abc"]


def test_without_candidates_every_golden_comment_is_missed(spark):
    golden = spark.createDataFrame([("g", 0, "same"), ("g", 1, "same"), ("h", 0, "one")], "golden_url string, golden_index int, comment string")
    cands = spark.createDataFrame([("h", "t", 0, "one")], "golden_url string, tool string, candidate_index int, text string")
    verdicts = judge.score_pairs(judge.pairs(judge.with_words(golden, "comment", "comment_words"), judge.with_words(cands, "text", "text_words")))
    got = {r.golden_url: (r.tp, r.fp, r.fn, r.recall) for r in judge.evaluate(golden, cands, verdicts, spark.createDataFrame([("g", "t"), ("h", "t")], "golden_url string, tool string")).collect()}
    assert got == {"g": (0, 0, 2, 0.0), "h": (1, 0, 0, 1.0)}


SWEEP = "model string, case_id string, golden_url string, review_url string, base_sha string, head_sha string, diff_sha256 string, semantic_sha256 string"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", {}), ("b", {})], None), ([("a", {})], None), ([("a", {"diff_sha256": "x", "semantic_sha256": "s"}), ("b", {"diff_sha256": "y", "semantic_sha256": "s"})], None),
        ([("a", {"diff_sha256": "x"}), ("b", {"diff_sha256": "y"})], "diffs differ"), ([("a", {"diff_sha256": "x", "semantic_sha256": "s"}), ("b", {"diff_sha256": "y", "semantic_sha256": "t"})], "diffs differ"),
        ([("a", {}), ("b", {"head_sha": "z"})], "snapshots differ"), ([("a", {}), ("b", {"head_sha": None})], "artifact lacks an identity"), ([("a", {}), ("b", {"diff_sha256": ""})], "artifact lacks an identity"), ([("a", {}), ("b", {}), ("b", {})], "several artifacts for a case"),
        ([("a", {"diff_sha256": None}), ("b", {"diff_sha256": None})], "artifact lacks an identity"), ([("a", {}), ("b", {}), ("c", {"case_id": "other"})], "case is missing for a model"),
    ],
)
def test_sweeps_are_comparable(spark, rows, want):
    base = {"case_id": "c", "golden_url": "g", "review_url": "r", "base_sha": "b", "head_sha": "h", "diff_sha256": "d", "semantic_sha256": None}
    df = spark.createDataFrame([(m, *{**base, **change}.values()) for m, change in rows], SWEEP)
    got = {r.case_id: r.reason for r in benchmark.sweep_violations(df).collect()}
    assert got.get("c") == want and benchmark.sweep_violations(df.where("false")).count() == 0


def test_meaning_of_a_diff(spark):
    ledger = diffs.ledger_arrays(spark.createDataFrame([(r, "RIGHT", "p", n) for r in ("x", "y") for n in ((1, 2, 5) if r == "x" else (5, 2, 1))] + [("z", "RIGHT", "p", 1)], "review_id string, side string, path string, line int"))
    rows = spark.createDataFrame([("x", "m", 3, 0, 1, 1), ("y", "m", 3, 0, 1, 1), ("z", "m", 1, 0, 1, 1), ("w", None, 3, 0, 1, 1)], "review_id string, merge_base_sha string, additions int, deletions int, files int, hunks int")
    got = {r.review_id: r.semantic_sha256 for r in benchmark.semantic_digest(rows, ledger).collect()}
    assert got["x"] == got["y"] != got["z"] and got["w"] is None


FINAL = {
    "review_id": "r", "finding_id": "rl-" + "0" * 20, "fingerprint": "f" * 64, "side": "RIGHT", "path": "p.py", "line": 3, "end_line": 4, "severity": "low", "category": "bug", "confidence": 0.5,
    **dict.fromkeys(("title", "body", "trigger", "impact", "evidence", "suggested_fix", "chunk_id"), "x"),
}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, None), ({"path": "../p"}, "unsafe path"), ({"path": None}, "unsafe path"), ({"line": 0}, "bad lines"), ({"end_line": 2}, "bad lines"), ({"side": "UP"}, "bad side"), ({"end_line": 9}, "not a changed line"), ({"finding_id": "rl-1"}, "bad id"),
        ({"fingerprint": "zz"}, "bad fingerprint"), ({"suggested_fix": "  "}, "empty text"), ({"chunk_id": None}, "empty text"), ({"category": "weird"}, "unknown severity or category"), ({"confidence": math.nan}, "bad confidence"), ({"confidence": 1.5}, "bad confidence"), ({"confidence": None}, "bad confidence"),
    ],
)
def test_final_findings_are_checked_again(spark, change, want):
    schema = ", ".join(f"{k} {'int' if 'line' in k else 'double' if k == 'confidence' else 'string'}" for k in FINAL)
    ranges = spark.createDataFrame([("r", "RIGHT", "p.py", 1, 5)], "review_id string, side string, path string, start int, end int")
    got = [r.reason for r in export.finding_violations(spark.createDataFrame([tuple({**FINAL, **change}.values())], schema), ranges).collect()]
    assert got == ([want] if want else [])
    if not change:
        other = spark.createDataFrame([tuple(FINAL.values()), tuple({**FINAL, "body": "y", "trigger": " ", "impact": "x"}.values()), tuple(FINAL.values())], schema)
        assert [r.reason for r in export.finding_violations(other, ranges).collect()].count("duplicate finding") == 2


def test_final_findings_are_made_once_and_counted_among_all(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    # the second is unsound and makes the first one no single; the third has another line, the fourth another text
    changes = ({}, {"confidence": 1.5}, {"line": 4, "end_line": 4}, {"title": "another"}, {"end_line": 9})
    schema = ", ".join(f"{k} {'int' if 'line' in k else 'double' if k == 'confidence' else 'string'}" for k in FINAL)
    rows = spark.createDataFrame([tuple({**FINAL, **c}.values()) for c in changes], schema).withColumn("path", F.udf(seen)("path"))
    ranges = spark.createDataFrame([("r", "RIGHT", "p.py", 1, 5)], "review_id string, side string, path string, start int, end int")
    got = export.finding_violations(rows, ranges)
    assert sorted(r.reason for r in got.collect()) == ["bad confidence", "duplicate finding", "not a changed line"] and got.columns == [*rows.columns, "reason"]
    assert made.value == len(changes)


def test_a_files_findings_meet_its_source_in_groups(spark, monkeypatch):
    monkeypatch.setattr(findings, "TOGETHER", 7)
    source = "\n".join(f"line {n}" for n in range(1, 41))
    rows = [("r", n, "RIGHT", "p", n, f"line {n} line {n + 1}") for n in range(1, 50)]
    facts = findings.source_facts(spark.createDataFrame(rows, "review_id string, seq int, side string, path string, line int, _evidence string"), spark.createDataFrame([("r", "RIGHT", "p", source)], "review_id string, side string, path string, content string"))
    got = {r.seq: (r._fact.n_lines, r._fact.present, r._fact.anchored) for r in facts.collect()}
    assert got == {n: (40, n < 40, n < 40) for n in range(1, 50)}
