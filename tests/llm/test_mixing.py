import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import mixing, q_mixing

DOCS = "doc_id long, text string, source string, target string, row string, one int, nth int"


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()[:16]


def targets(sizes):
    """Target of each source of {source: size}: shares by weight, those above three times their size stopped, until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while open_ := [s for s in names if s not in out]:
        share = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share >= 3 * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
    return out


def brute(rows):
    """(doc_id, size, source_size, target, taken, copies_taken) of rows (doc_id, text, source)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    goal, order = targets(sizes), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    mix = []
    for nth, s in enumerate(order):
        for e in range(min(3, math.ceil(goal[s] / sizes[s])) if sizes[s] else 0):
            queue = sorted((md5(f"{md5(str(d) if d is not None else t or '')}:{e}"), size[i], i) for i, (d, t, own) in enumerate(rows) if own == s and size[i])
            done = e * sizes[s]
            for turn, n, i in queue:
                done += n
                mix.append((done / goal[s], nth, turn, n, i))
    place, taken = 0, defaultdict(list)
    for *_, n, i in sorted(mix):
        place += n
        if place > sum(size):
            break
        taken[i].append(n)
    return [(d, size[i], sizes[s], pytest.approx(goal[s]), sum(taken[i]), len(taken[i])) for i, (d, _, s) in enumerate(rows)]


def rows_of(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "B", "é", "", None, "z", "only one", "huge"]
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.9) + rng.randrange(8))) + "\n", rng.choices(sources, [30, 9, 5, 3, 4, 20, 1, 140])[0]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \t ", None), (5, "again and again", "z"), (5, "again and again", "z"), (None, "no id of its own", "z"), (None, None, None), (n + 3, "w " * 40_000, "huge")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_brute_force_and_sql(spark, tmp_path, seed):
    rows = rows_of(seed)
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = q_mixing.op11_mixing(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    assert sorted(map(tuple, out), key=key) == sorted(brute(rows), key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(q_mixing.ORACLE["op11_mixing"]).fetchall(), key=key) == sorted(map(tuple, out), key=key)
    assert all(r.taken <= 3 * r.size for r in out) and sum(r.taken for r in out) <= sum(r.size for r in out)


def test_sources_come_near_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 30), f"s{rng.choices(range(6), [1, 30, 5, 5, 2, 60])[0]}") for i in range(6000)]
    out = mixing.taken(frame(spark, rows)).join(frame(spark, rows).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert len(out) == 6 and all(abs(r.taken - r.target) <= 60 for r in out)
    assert any(r.target == 3 * r["size"] for r in out) and any(r.target < r["size"] for r in out)


def test_mix_is_in_order_and_does_not_depend_on_partitions(spark):
    df = frame(spark, rows_of(3))
    got = [sorted((r.place, r.size, r.epoch, r.source, r.doc_id or -1) for r in mixing.mixed(x).collect()) for x in (df, df.repartition(7))]
    assert [[r[:4] for r in g] for g in got][0] == [[r[:4] for r in g] for g in got][1]
    places = [r[0] for r in got[0]]
    assert len(set(places)) == len(places) and all(b - a == r[1] for a, b, r in zip(places, places[1:], got[0][1:]))


def test_no_rows_no_words_and_running_sums(spark):
    none = frame(spark, []).where("false")
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0
    assert [tuple(r) for r in mixing.taken(frame(spark, [(1, None, None), (2, "", "a")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    one = mixing.taken(frame(spark, [(1, "a b c", "s")])).first()
    assert (one.target, one.taken) == (3.0, 3)
    df = spark.createDataFrame(pd.DataFrame({"k": [5, 3, 3, 9, 1], "v": [1, 2, 4, 8, 16]}))
    assert sorted(r.s for r in mixing.running(df, ["k", "v"], {"s": "v"}, "t").collect()) == [16, 18, 22, 23, 31]
