import numpy as np

from reviewlake.llm import suffixes


def brute(texts):
    """Words inside windows of 50 that another document has."""
    words = {d: [w.lower() for w in (t or "").split()] for d, t in texts}
    where = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(d)
    out = {}
    for d, w in words.items():
        hit = set()
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                hit |= set(range(i, i + 50))
        if hit:
            out[d] = hit
    return out


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.n_words >= 50 and r.other_doc != r.doc_id
    return out


def test_spans_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocab[i] for i in rng.integers(0, 3000, n)]
    passages = [draw(n) for n in (50, 51, 64, 120, 49)]
    texts = []
    for d in range(60):
        w = draw(int(rng.integers(0, 200)))
        p = passages[d % 5] if d % 3 else []
        texts.append((d, " ".join(w + p + draw(int(rng.integers(0, 80))))))
    texts += [(100 + i, texts[7][1]) for i in range(20)]
    texts += [(200, " ".join(["again"] * 300)), (201, " ".join(["again"] * 200)), (202, None), (203, ""), (203, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert covered(suffixes.spans(df)) == brute(texts)


def test_result_does_not_depend_on_partitions(spark):
    p = " ".join(f"p{i}" for i in range(70))
    texts = [(d, " ".join(f"x{d}_{i}" for i in range(30)) + " " + p) for d in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {d: set(range(30, 100)) for d in range(300)}

    assert covered(suffixes.spans(df)) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        assert covered(suffixes.spans(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, anchor string, pos string")
    assert suffixes.spans(empty).count() == 0
    rows = spark.createDataFrame([(f"d{i}", " ".join(f"w{k}" for k in range(60))) for i in range(3)], "doc_id string, text string")
    got = [(r.doc_id, r.start, r.end, r.other_doc) for r in suffixes.spans(rows).collect()]
    assert sorted(x[:3] for x in got) == [(f"d{i}", 0, 60) for i in range(3)] and all(x[3] != x[0] for x in got)


def test_no_partner_hides_another(spark):
    """A frequent run with many contexts: pairs that share words on both sides of it, and no neighbours in any one order."""
    rng = np.random.default_rng(5)
    common_run = [f"c{i}" for i in range(36)]
    lefts, rights = [[f"l{k}_{i}" for i in range(30)] for k in range(12)], [[f"r{k}_{i}" for i in range(30)] for k in range(12)]
    texts = []
    for d in range(400):
        l, r = lefts[rng.integers(12)], rights[rng.integers(12)]
        a, b = int(rng.integers(0, 25)), int(rng.integers(0, 25))
        own = [f"x{d}_{i}" for i in range(20)]
        texts.append((d, " ".join(own + (l[-a:] if a else []) + common_run + r[:b] + own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts)
    assert covered(suffixes.spans(df)) == want and 100 < len(want)


def test_very_long_and_repetitive_texts(spark):
    rng = np.random.default_rng(6)
    long = [f"w{i}" for i in rng.integers(0, 500, 60_000)]
    line = [f"again{i}" for i in range(45)]
    texts = [(1, " ".join(long)), (2, " ".join(["own"] * 9 + long[30_000:30_200] + line * 300)), (3, " ".join(line * 200)), (4, " ".join(line))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert covered(suffixes.spans(df)) == brute(texts)
