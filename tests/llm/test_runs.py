import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.llm import q_runs, runs


def brute(words, least=24, times=3):
    """All runs, by their definition: for each period, stretches whose words repeat at it, the smallest period of each."""
    n, best = len(words), {}
    for p in range(1, n // times + 1):
        start = 0
        for i in range(p, n + 1):
            if i == n or words[i] != words[i - p]:
                length = i - start
                if length >= max(least, times * p):
                    best.setdefault((start, length), p)
                start = i - p + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def texts():
    rng = random.Random(3)
    some = lambda n, k: [rng.choice("abcdefghij"[:k]) for _ in range(n)]
    out = [some(rng.randrange(0, 60), 2) for _ in range(40)]
    for _ in range(60):
        base = some(rng.randrange(1, 30), rng.randrange(1, 10))
        mid = [base[i % len(base)] for i in range(rng.randrange(0, 150))]
        out.append(some(rng.randrange(0, 20), 3) + mid + some(rng.randrange(0, 20), 3) + mid[: rng.randrange(0, 90)])
    a, b = ["x"], ["x", "y"]
    while len(b) < 500:
        a, b = b, b + a
    return [*out, b, ["w"] * 300, ["w"] * 23, ["w"] * 24, [], ["a", "b"] * 12, (["a"] * 5 + ["b"]) * 30 + ["a"] * 60]


def test_runs_equal_brute_force_alone_and_together():
    words = [[w.encode() for w in t] for t in texts()]
    want = [brute(t) for t in words]
    assert sum(map(len, want)) > 60
    for block in (words, words[::-1]):
        got = [[(r["start"], r["length"], r["period"]) for r in x[-1]] for x in runs.results(block, 24, 3)]
        assert got == [brute(t) for t in block]
    for least, times in ((6, 3), (40, 4), (10, 5)):
        assert [[(r["start"], r["length"], r["period"]) for r in x[-1]] for x in runs.results(words, least, times)] == [brute(t, least, times) for t in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=90), max_size=5))
def test_any_words(block):
    got = [[(r["start"], r["length"], r["period"]) for r in x[-1]] for x in runs.results(block, 9, 3)]
    assert got == [brute(t, 9) for t in block]


def test_suffix_order_is_one_of_prefixes():
    rng = np.random.default_rng(1)
    symbols = np.r_[rng.integers(0, 3, 200), 99]
    order, shared = runs.suffix_order(symbols)
    suffixes = [tuple(symbols[i:].tolist()) for i in order]
    assert suffixes == sorted(suffixes) and shared[0] == 0
    assert shared[1:].tolist() == [next(k for k in range(300) if a[k] != b[k]) for a, b in zip(suffixes, suffixes[1:])]


def test_one_word_many_times_is_not_quadratic():
    (n, start, length, period, milli, _, left, _), *_ = runs.results([[b"w"] * 200_000, []], 24, 3)
    assert (n, start, length, period, milli, left) == (1, 0, 200_000, 1, 200_000_000, "w")


def expected(doc_id, text):
    """The row of one document, from the contract."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(listed.encode()), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(300)]
    rows += [(1000 + i, "\n".join(t) + "\t") for i, t in enumerate(map(" ".join, zip(*[iter("abcabcabdé" * 9)] * 3)))]
    rows += [(2000 + i, " ".join(t)) for i, t in enumerate(texts())] + [(7, None), (None, "a b " * 20), (8, ""), (8, ""), (12, " \n ")]
    spark.createDataFrame([(a, b, "x", a) for a, b in rows], "doc_id long, text string, runs string, start long").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_runs.op12_runs(spark, str(tmp_path))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r.n_runs > 0 for r in out.collect()) > 40


def test_collapsed_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a b c " * 20, "r"), (1, None, None), (2, "x  y", "q")], "doc_id long, text string, _runs string")
    assert sorted(map(tuple, runs.collapsed(df).collect()), key=str) == [(1, "a b c", "r"), (1, None, None), (2, "x  y", "q")]
    assert runs.collapsed(df.where("false")).count() == 0
    assert spark.createDataFrame([("a " * 30,)], "text string").select(runs.found(F.col("text"), words=1).n_runs).first()[0] == 1
