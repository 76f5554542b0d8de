import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import brown

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_base_scores_match_brute_force_and_model_beats_base(spark):
    texts = ["The cat saw the dog. " * 5, None, "", "É a\tb\nc. THE cat", "x1 y@z 12 the dog"] + [f"the cat{i % 7} saw a dog{i % 5}, then it ran. " * 3 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    params = brown.Params(classes=4, min_count=6, sweeps=3)
    model = brown.train(docs.where(~brown.held_out(F.col("doc_id"))), params)
    got = {r.doc_id: r for r in brown.scored(docs, model).collect()}
    toks = {i: WORDS.findall(lower(t)) + [brown.END] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, ws in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    assert sum(r.score for i, r in got.items() if held[i]) > sum(r.base_score for i, r in got.items() if held[i])
    # the scores themselves, from the model's classes alone
    place = {w: i for w in counts if (i := brown.Lookup(model.hashes).of([w.encode()])[w.encode()]) >= 0}
    assert place.keys() == {w for w in counts if w != brown.END and counts[w] >= 6} and 0.5 < model.covered < 1
    assert all(model.counts[i] == counts[w] for w, i in place.items())
    assert model.covered == pytest.approx(sum(counts[w] for w in place) / (n - counts[brown.END]))
    cls = lambda w: model.end if w == brown.END else model.classes[place[w]] if w in place else 4 + brown.shape(w.encode())
    table = Counter((cls(a), cls(b)) for i, ws in toks.items() if not held[i] for a, b in zip([brown.END, *ws], ws))
    assert all(model.table[a, b] == table[a, b] for a in range(model.end + 1) for b in range(model.end + 1))
    size, kinds, trans = Counter(), Counter(), 10 ** model.log_transition()
    for w, c in counts.items():
        size[cls(w)] += c
        kinds[cls(w)] += 1

    def p(w, before):
        c = cls(w)
        emit = counts[w] / size[c] if w in place or w == brown.END else (counts[w] + 1) / (size[c] + kinds[c] + 1)
        return 0.9 * trans[cls(before), c] * emit + 0.1 * (counts[w] + 1) / (n + v + 1)

    for i, ws in toks.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(w, b)) for b, w in zip([brown.END, *ws], ws)))


def test_exchange_raises_likelihood_and_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    kinds = [[f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)], [f"a{i}" for i in range(20)]]
    docs = spark.createDataFrame([(i, " ".join(str(rng.choice(kinds[k % 3])) for k in range(30))) for i in range(400)], "doc_id long, text string")
    params = brown.Params(classes=3, min_count=2, sweeps=8, least_moved=0.0)
    first, model = brown.train(docs, brown.Params(classes=3, min_count=2, sweeps=0)), brown.train(docs, params)
    assert brown.likelihood(model.table) > brown.likelihood(first.table) and len(model.classes) == 60 and model.covered == 1
    again = brown.train(docs.repartition(7), brown.Params(classes=3, min_count=2, sweeps=8, least_moved=0.0, block=8))
    assert (again.hashes == model.hashes).all() and (again.classes == model.classes).all() and (again.table == model.table).all()


def test_tokens_and_shapes_of_whole_columns_are_those_of_each_text():
    texts = ["The cat\x1c saw\x0bthe dog. ", None, "", "  \t", "É a\tb\nc. THE cat\u00a0x\u2028y", "x1 y@z a@1 12 1.5 i, b! c- -c a-b -- . , ! É. É, ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "w" * 90, "\x00 @"]
    for part in (texts, texts[1:3], [""], ["a"]):
        at, words, ends = brown.tokens(pa.array(part, pa.string()))
        want = [[*WORDS.findall(lower(t)), None] for t in part]
        assert [None if i < 0 else words[i].as_py() for i in at.tolist()] == sum(want, []) and ends.tolist() == (np.cumsum([len(w) for w in want]) - 1).tolist()
        assert brown.shapes(words).tolist() == [brown.shape(w.encode()) if w else s for w, s in zip(words.to_pylist(), brown.shapes(words).tolist(), strict=True)]
    sliced = pa.array(texts, pa.large_string()).slice(4, 2)
    assert brown.tokens(sliced)[2].tolist() == (np.cumsum([len(WORDS.findall(t)) + 1 for t in texts[4:6]]) - 1).tolist()


def test_parts_are_bounded_by_bytes_and_leave_no_text_out(monkeypatch):
    monkeypatch.setattr(brown, "PART", 10)
    texts = ["aaaa", None, "bbbbbbb", "c" * 50, "", "d", "eeeeeeeee"]
    parts = [p.column("text").to_pylist() for p in brown.slices(iter([pa.record_batch({"text": pa.array(texts)}), pa.record_batch({"text": pa.array([], pa.string())})]))]
    assert sum(parts, []) == texts and all(sum(len(t or "") for t in p[1:]) < 10 for p in parts) and len(parts) > 3


def test_large_sums_take_more_entries():
    cells, sums = brown._packed(np.array([1, 5]), np.array([200_000, 7]))
    group = pa.table({"cells": pa.array([cells], pa.binary()), "sums": pa.array([sums], pa.binary())})
    assert brown._unpacked(group, 6)[[1, 5]].tolist() == [200_000, 7]


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b c. d, e1 ff ggg a b") for i in range(5)], "doc_id long, text string")
    model = brown.train(docs, brown.Params(classes=2, min_count=6, sweeps=1))
    words = ["a", "b", "c.", "d,", "e1", "ff", "ggg"]
    single = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    tail = 10 ** brown.scored(spark.createDataFrame([(0, "")], "doc_id long, text string"), model).first().score
    # p(w | start) * p(end | w) for each w; divide by p(end | w) through p(w w) is not needed: compare with the table
    t = 10 ** model.log_transition()
    assert abs(t.sum(1) - 1).max() < 1e-9
    assert 0 < tail < 1 and brown.scored(single, model).where("score >= 0").count() == 0


def test_threshold(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + i * i) for i in range(100)], "w string, n long")
    assert brown.threshold(df, brown.Params(min_count=50)) == 50
    least = brown.threshold(df, brown.Params(min_count=50, most=20))
    assert 15 <= df.where(df.n >= least).count() <= 20 and df.where(df.n >= brown.threshold(df, brown.Params(most=0))).count() == 0


def test_empty_training_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = brown.train(none)
    assert brown.scored(none, model).count() == 0
    r = brown.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert r.n_tokens == 3 and r.n_known == 0 and math.isfinite(r.score) and r.base_score == 0.0
