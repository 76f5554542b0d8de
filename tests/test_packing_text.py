import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.functions import paths, text
from reviewlake.operators import packing

ODD = ["", " ", "a b c", "a b\u0085c", "\x1c x \x1f", "a\r\nb\rc\n", "a\n\nb", "İstanbul\x0b", "x\r", "\n"]


def one(spark, rows, *cols):
    return spark.createDataFrame([(r,) for r in rows], "c string").select(*cols).collect()


def test_lines_and_white_space_are_pythons(spark):
    got = one(spark, ODD, "c", text.norm_space(F.col("c")).alias("n"), text.py_splitlines(F.col("c")).alias("l"), text.strip(F.col("c")).alias("s"))
    assert all((r.n, r.l, r.s) == (" ".join(r.c.split()), r.c.splitlines(), r.c.strip()) for r in got)


def test_lf_records_rebuild_the_text(spark):
    for r in one(spark, ODD, "c", text.lf_lines(F.col("c")).alias("l")):
        assert "".join(x.text + x.ending for x in r.l) == r.c and all("\n" not in x.text for x in r.l)


def test_clip_and_wrap(spark):
    r = one(spark, ["x" * 100], text.clip_text(F.col("c"), 60, "t").alias("a"), text.clip_text(F.col("c"), 10, "t").alias("b"), text.clip_text(F.col("c"), 100, "t").alias("c"), text.token_estimate(F.col("c")).alias("n"))[0]
    assert len(r.a) == 60 and r.a.endswith("\n...[t truncated at 60 characters]") and r.b == "\n...[t tru" and len(r.c) == 100 and r.n == 25
    digest = hashlib.sha256(b"x").hexdigest()
    assert f"<<<L {digest[:16]}>>>" in one(spark, ["x"], text.wrap_untrusted("L", F.col("c")).alias("w"))[0].w


@given(st.text(alphabet='a"\\\\\n\x01é', max_size=30), st.integers(0, 40), st.integers(0, 60))
def test_json_prefix_is_the_longest(value, limit, json_limit):
    size = lambda n: len(json.dumps(value[:n], ensure_ascii=False)) - 2
    got = text.json_prefix(value, limit, json_limit)
    assert len(got) == max(n for n in range(min(len(value), limit) + 1) if size(n) <= json_limit)


def test_clip_json_column(spark):
    assert one(spark, ["a\nb\nc"], text.clip_json(F.col("c"), 5, 4).alias("x"))[0].x == "a\nb"


def test_hashes_and_json(spark):
    r = one(spark, ['é"/\x01'], text.nul_hash(F.col("c"), F.lit(None), F.lit(3)).alias("h"), text.canonical_json(F.struct(F.col("c").alias("a"), F.lit(None).cast("string").alias("b"))).alias("j"))[0]
    assert r.h == hashlib.sha256('é"/\x01\0\x003'.encode()).hexdigest()
    assert r.j == json.dumps({"a": 'é"/\x01', "b": None}, ensure_ascii=False, separators=(",", ":"))


def test_redaction_takes_longest_secret_first(spark):
    r = one(spark, ["url https://k:abc@h abc Bearer x.y-z sk-123456789 api_key: q,"], text.redact(F.col("c"), ["abc", "https://k:abc@h"]).alias("r"))[0]
    assert r.r == "url [REDACTED] [REDACTED] Bearer [REDACTED] [REDACTED] api_key: [REDACTED],"


def test_paths(spark):
    rows = ["a/b", " a//b ", "/a", "../a", "a/../b", ".", "", "a\\b", "./a"]
    got = {r.c: r.p for r in one(spark, rows, "c", paths.canonical_path(F.col("c")).alias("p"))}
    assert got == {"a/b": "a/b", " a//b ": "a/b", "/a": None, "../a": None, "a/../b": None, ".": None, "": None, "a\\b": "a/b", "./a": "a"}
    tests = {r.c: r.t for r in one(spark, ["tests/x.py", "src/test_a.py", "a.spec.ts", "src/contest.py", "latest/x.py"], "c", paths.is_test_path(F.col("c")).alias("t"))}
    assert tests == {"tests/x.py": True, "src/test_a.py": True, "a.spec.ts": True, "src/contest.py": True, "latest/x.py": False}


def brute_next_fit(xs, cap, sep, most):
    groups, at = [], []
    for x in xs:
        if at and (sum(at) + sep * len(at) + x > cap or len(at) >= most):
            groups.append(at)
            at = []
        at.append(x)
    return [i for i, g in enumerate([*groups, at] if at else groups) for _ in g]


@given(st.lists(st.integers(0, 30), max_size=12), st.integers(1, 40), st.integers(0, 3), st.integers(1, 4))
def test_next_fit(xs, cap, sep, most):
    assert packing.next_fit(xs, cap, sep, max_items=most) == brute_next_fit(xs, cap, sep, most)


@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.integers(0, 120))
def test_fair_allocations_spend_what_they_can(xs, budget):
    got = packing.fair_allocations(xs, budget)
    assert all(0 <= g <= x for g, x in zip(got, xs, strict=True))
    assert sum(got) == min(sum(xs), max(0, budget - 2 * (len(xs) - 1)))
    cut = [g for g, x in zip(got, xs, strict=True) if g < x]
    assert not cut or max(got) <= min(cut) + 1


def test_sql_twins_agree(spark):
    groups = {k: [(k * 7 + i * 5) % 31 for i in range(k)] for k in range(1, 12)}
    df = spark.createDataFrame([(k, i, n) for k, xs in groups.items() for i, n in enumerate(xs)], "k int, i int, n int")
    by = lambda d, c: {(r.k, r.i): r[c] for r in d.collect()}
    packed, fair, fit = by(packing.pack(df, ["k"], ["i"], "n", 40, 2, max_items=3), "group_index"), by(packing.fair_share(df, ["k"], ["i"], "n", 60), "allocation"), by(packing.render_fitting(df, ["k"], ["i"], "n", 50), "kept")
    for k, xs in groups.items():
        assert [packed[k, i] for i in range(k)] == packing.next_fit(xs, 40, 2, max_items=3)
        assert [fair[k, i] for i in range(k)] == packing.fair_allocations(xs, 60)
        assert [fit[k, i] for i in range(k)] == packing.skip_fit(xs, 50)


def test_anchor_stays_when_it_grows(spark):
    assert packing.grow([5, 5, 5, 50, 5], 2, 20) == [0, 1, 2]
    lines = spark.createDataFrame([("f", i, f"line {i}") for i in range(1, 9)], "file string, line_no int, text string")
    at = spark.createDataFrame([("x", "f", 5)], "id string, file string, line int")
    got = packing.anchor_excerpts(lines, at, ["id"], ["file"], radius=2, cap=32).first().excerpt
    assert got == "     4 | line 4\n     5 | line 5"


@pytest.mark.parametrize("cap", [None, 1000])
def test_excerpt_whole(spark, cap):
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 4)], "file string, line_no int, text string")
    at = spark.createDataFrame([("x", "f", 1)], "id string, file string, line int")
    assert packing.anchor_excerpts(lines, at, ["id"], ["file"], cap=cap).first().excerpt == "     1 | l1\n     2 | l2\n     3 | l3"
