import numpy as np
import pytest

import corpus_pipeline
from reviewlake.llm import near_copies, simhash


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_labels(texts):
    sets = {d: brute_set(t) for d, t in texts}
    label = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9))]
    for _ in sets:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label, pairs


def made_texts():
    """Groups of copies with some words changed, at similarities on both sides of 0.8, all with a common passage."""
    rng, texts = np.random.default_rng(3), []
    passage = [f"p{i}" for i in range(12)]
    for _ in range(14):
        base = [f"w{i}" for i in rng.integers(0, 3000, int(rng.integers(20, 200)))]
        for copy in range(8):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 40)) if copy else 0):
                w[at] = f"new{rng.integers(0, 9999)}"
            texts.append((len(texts), " ".join(w + passage)))
    return [*texts, (500, "only three words"), (501, "Only THREE  words"), (502, ""), (503, None), (504, texts[3][1].upper())]


@pytest.mark.parametrize("frequent", [1, 4])
def test_components_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    texts = made_texts()
    want, pairs = brute_labels(texts)
    got = {r.doc_id: r.component_id for r in near_copies.linked(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and len(pairs) > 50 and len(set(want.values())) < len(want)


def test_stage_drops_copies_beyond_three_bits(spark):
    words = [f"w{i}" for i in np.random.default_rng(8).integers(0, 5000, 120)]
    near = [*words[:60], "changed", *words[61:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:70])), (None, " ".join(words))]
    a, b = (simhash.fingerprint(rows[i][1]) & (2**64 - 1) for i in (0, 1))
    assert bin(a ^ b).count("1") > simhash.MAX_BITS
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


def test_parities_never_exceed_the_difference():
    for n, m in ((3, 4), (500, 600), (510, 520), (4000, 4100)):
        a, b = (near_copies.shingle_set(" ".join(f"w{i}" for i in range(k))) for k in (n, m))
        c = near_copies.shingle_set(" ".join(f"v{i}" for i in range(n)))
        difference = lambda x, y: len(np.setxor1d(x, y))
        assert near_copies.apart(near_copies.parities(a), near_copies.parities(b)) <= difference(a, b)
        assert len(a) / 2 < near_copies.apart(near_copies.parities(a), near_copies.parities(c)) <= difference(a, c)
