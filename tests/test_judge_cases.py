"""The judge's queries compare every turn of the conversations with golden issues, however many more turns there are than items."""

import hashlib

import duckdb
import pytest

from reviewlake.operators import judge
from reviewlake.queries import q_judge

ROLES = ("user", "assistant")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """16 items and 108 conversations of two turns: of nine cases of twelve conversations that follow one another, five would have no item."""
    d = str(tmp_path_factory.mktemp("judge"))
    spark.createDataFrame([(i, f"the lock of cache {i % 5} is not released") for i in range(16)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    turns = [(c, t, role, f"cache {(c + t) % 7} has a lock that conversation {c} holds") for c in range(108) for t, role in enumerate(ROLES)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def sql(d, name):
    con = duckdb.connect()
    for t in ("benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return sorted(con.sql(q_judge.ORACLE[name]).fetchall(), key=str)


def rows(spark, d, name):
    got = sorted(map(tuple, q_judge.QUERIES[name](spark, d).collect()), key=str)
    assert got == sql(d, name)
    return got


def test_metrics_count_the_golden_issues_of_eight_cases(spark, tables):
    got = rows(spark, tables, "judge_metrics")
    # eight cases of two items each; in cases of items that follow one another there would be four
    assert [(r[0], r[5]) for r in got] == [("assistant", 8), ("user", 8)] and all(r[1] + r[3] == 16 for r in got)


def test_no_evaluation_is_skipped_where_items_are_fewer(spark, tables):
    got = rows(spark, tables, "judge_evaluations")
    assert len(got) == 16 and not any(r[2] for r in got) and all(r[8] == 2 for r in got)


def test_rollup_has_all_reviews_of_eight_cases(spark, tables):
    got = rows(spark, tables, "judge_rollup")
    assert len(got) == 16 + 2 + 1 and [r[6] for r in got if r[:2] == ("all", "all")] == [16]


def test_running_best_goes_over_all_pairs(spark, tables):
    got = rows(spark, tables, "judge_running_best")
    # each item has a best one among each tool's candidates of its case, whose numbers go on to the last conversation's
    assert {r[:3] for r in got} == {(f"case-{i}", t, g) for i in range(8) for t in ROLES for g in range(2)}


def test_deltas_are_of_eight_cases(spark, tables):
    assert rows(spark, tables, "paired_deltas")[0][0] == 8


def test_forced_reviews_are_of_eight_cases(spark, tables):
    got = rows(spark, tables, "judge_resume")
    assert {r[0] for r in got if r[1] == "user"} == {f"case-{i}" for i in range(8)}


def test_scorer_sees_all_pairs(spark, tables):
    got = rows(spark, tables, "scored_pairs")
    # each of 216 turns meets the two items of its case
    assert len(got) == 16 and sum(r[2] for r in got) == 216 * 2


def test_verdicts_meet_pairs_without_their_texts(spark):
    pairs = spark.createDataFrame([(0, "a", "bc"), (1, "ab", "c"), (2, "a", "bc"), (3, None, "c")], "i int, comment string, text string")

    def scorer(df):
        assert list(df.columns) == ["comment", "text"]
        return df.assign(match=df.comment == "a", confidence=df.text.str.len() / 10, error=None)

    out = judge.score_pairs(pairs, scorer)
    assert {r.i: (r.match, r.confidence) for r in out.collect()} == {0: (True, 0.2), 1: (False, 0.1), 2: (True, 0.2), 3: (None, None)}
    # texts are shuffled where they are scored, not where verdicts meet pairs
    plan = out.select("i", "confidence")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_pair" in plan and "hashpartitioning(comment" not in plan


def test_pairs_of_one_md5_keep_their_own_verdicts(spark):
    # two texts of Wang and others (2004) with one MD5, as bytes, since they are no UTF-8
    a = bytes.fromhex(
        "d131dd02c5e6eec4693d9a0698aff95c2fcab58712467eab4004583eb8fb7f8955ad340609f4b30283e488832571415a085125e8f7cdc99fd91dbdf280373c5b"
        "d8823e3156348f5bae6dacd436c919c6dd53e2b487da03fd02396306d248cda0e99f33420f577ee8ce54b67080a80d1ec69821bcb6a8839396f9652b6ff72a70"
    )
    b = bytes(x ^ {19: 128, 45: 128, 59: 128, 83: 128, 109: 128, 123: 128}.get(i, 0) for i, x in enumerate(a))
    assert a != b and hashlib.md5(a).digest() == hashlib.md5(b).digest()
    pairs = spark.createDataFrame([(0, b"g", a), (1, b"g", b)], "i int, comment binary, text binary")

    def scorer(df):
        return df.assign(match=[bytes(t)[19] == a[19] for t in df.text], confidence=0.5, error=None)

    assert sorted((r.i, r.match) for r in judge.score_pairs(pairs, scorer).collect()) == [(0, True), (1, False)]
