import base64

import tiktoken

from reviewlake.llm import token_counts as t
from reviewlake.llm.q_token_counts import VERSIONS, op6_token_counts

VERSION, VOCABULARY = next(iter(VERSIONS.items()))


def brute(text, path=VOCABULARY):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return len(tiktoken.Encoding("x", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or ""))


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_insert_revise_delete_and_replay(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, version string"
    docs = spark.createDataFrame([(1, "one two three", "en", "a", "z"), (2, None, "en", "a", "z"), (3, "quatre <|endoftext|>", None, "b", "z"), (3, "quatre <|endoftext|>", None, "b", "z")], schema)
    kept = t.Rollup(spark, f"file://{tmp_path}/r")
    load = t.counted(docs, VERSION, VOCABULARY)
    assert kept.commit(1, load) and not kept.commit(1, load)
    n1, n3 = brute("one two three"), brute("quatre <|endoftext|>")
    assert totals(kept) == {("a", "en", VERSION): (2, n1), ("b", None, VERSION): (2, 2 * n3)}
    new = spark.createDataFrame([(1, "one", "en", "c", "z")], schema)
    assert kept.commit(2, kept.revision(t.counted(new, VERSION, VOCABULARY)))
    assert totals(kept) == {("a", "en", VERSION): (1, 0), ("c", "en", VERSION): (1, brute("one")), ("b", None, VERSION): (2, 2 * n3)}
    gone = spark.createDataFrame([(3,)], "doc_id long")
    assert kept.commit(3, kept.deletion(gone)) and not kept.commit(3, kept.deletion(gone))
    assert totals(kept) == {("a", "en", VERSION): (1, 0), ("c", "en", VERSION): (1, brute("one"))}


def test_half_written_batch_is_written_anew(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "a")], "doc_id long, text string, lang string, source string")
    kept = t.Rollup(spark, f"file://{tmp_path}/r")
    kept.commit(1, t.counted(docs, VERSION, VOCABULARY))
    before = totals(kept)
    t.counted(docs, VERSION, VOCABULARY).write.parquet(f"{kept.path}/ledger/batch=2")  # no commit follows
    assert totals(kept) == before
    assert kept.commit(2, t.counted(docs.limit(0), VERSION, VOCABULARY)) and totals(kept) == before


def test_empty_table(spark, tmp_path):
    kept = t.Rollup(spark, f"file://{tmp_path}/r")
    kept.commit(1, t.counted(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), VERSION, VOCABULARY))
    assert totals(kept) == {}


def test_query_gives_plain_totals(spark, tmp_path):
    rows = [(0, "one two, three", "en", "a"), (1, None, "en", "a"), (2, "vier", None, "b"), (2, "vier", None, "b"), (None, "no id", "en", None), (-5, "", "de", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for version, path in VERSIONS.items():
        for _, text, lang, source in rows:
            n = want.setdefault((source, lang, version), [0, 0])
            n[0] += 1
            n[1] += brute(text, path)
    assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in op6_token_counts(spark, str(tmp_path)).collect()} == want
