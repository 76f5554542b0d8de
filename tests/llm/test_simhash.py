import numpy as np
import xxhash
from pyspark.sql import functions as F

from reviewlake.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprint_matches_brute_force():
    for text in [None, "", " \n", "One", "one TWO", "a b c", "é É x y Z é É x y", "w " * 50, " ".join(map(str, range(6000)))]:
        assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(1)
    prints = {}
    for base in rng.integers(0, 2**63, 12):
        at = int(base)
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                at ^= 1 << int(bit)
            prints[len(prints) * 3 + 1] = at
    rows = [(k, v - 2**64 if v >= 2**63 else v) for k, v in prints.items()]
    df = spark.createDataFrame(rows + [(900, rows[0][1]), (901, rows[0][1])], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.components(df).collect()}
    want = brute_components(prints)
    assert {k: got[fp] for k, fp in rows} == want


def test_dense_group_gives_one_component(spark):
    # all pairs of 1-bit and 2-bit changes of one fingerprint
    changed = [0] + [1 << i for i in range(63)] + [1 << i | 1 << j for i in range(20) for j in range(i)]
    df = spark.createDataFrame([(i, x ^ 0x1234567890ABCDE) for i, x in enumerate(changed)], "doc_id long, fp long")
    assert [r[0] for r in simhash.components(df).select("component_id").distinct().collect()] == [0]


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, node string"
    empty = spark.createDataFrame([], schema)
    assert simhash.linked(empty).count() == 0 and simhash.keep_first(empty).columns == empty.columns
    rows = [(5, None, "x", "a"), (3, "", "x", "b"), (9, "lone words in here now", None, "c"), (9, "lone words in here now", None, "c"), (None, "other words of this text", None, "d")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id, r.component_id) for r in simhash.linked(df).collect() if r.doc_id is not None)
    assert got == [(3, 3), (5, 3), (9, 9), (9, 9)]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.node for r in kept.collect()) == ["b", "c", "d"]
    assert kept.where(F.col("doc_id") == 9).count() == 1
