import random

import public_tokenizers

import corpus_pipeline
from reviewlake.llm import bpe, decontam, line_dedup, quality, simhash
from tests.llm.test_near_copies import brute_labels

PROSE = "the cat and the dog of the house went to the river in the morning and it was {} for the {} to be with {} of the {} as they said by the {} on that day"


def docs_of():
    rows = []
    for i in range(60):
        words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(5)]
        rows.append((i, PROSE.format(*words) + f"\nShared line number one here\nown {' '.join(words)}", "en", f"s{i % 3}", 1))
    rows += [(70, rows[5][1], "en", "s", 1), (71, "short", "en", "s", 1), (72, None, None, None, None), (73, "word " * 80, "en", "s", 1)]
    rows.append((74, rows[9][1] + " " + " ".join(f"q{k}" for k in range(30)), "en", "s", 1))
    # near copies of one long line, with a word changed; and one with too many
    words = random.Random(1).choices([w for w in PROSE.split() if w != "{}"], k=130)
    near, far = list(words), list(words)
    near[60] = "changed"
    far[::10] = [f"other{chr(97 + i)}" for i in range(13)]
    rows += [(80 + i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far))]
    return rows


def test_run_matches_plain_code(spark, tmp_path):
    rows = docs_of()
    item = " ".join(f"q{k}" for k in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r["_row"].doc_id for r in quality.judged(df, quality.references(df)).collect() if r.kept}
    texts = {d: t for d, t, *_ in rows if d in good}
    first = {}
    for d in sorted(texts):
        for line in (texts[d] or "").split("\n"):
            first.setdefault(line.strip().lower(), d)
    texts = {d: "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == d) for d, t in texts.items()}
    label, _ = brute_labels(list(texts.items()))
    assert {80, 81, 82} <= set(label) and label[81] == 80 and label[82] == 82
    texts = {d: t for d, t in texts.items() if label[d] == d and item not in t.lower()}
    assert set(got) == set(texts) and 5 in got and 74 not in got and not {71, 72, 73} & set(got)
    encoder = bpe.Encoder(bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")))
    assert all(bytes(got[d].ids) == encoder.encode(t) for d, t in texts.items())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h1 string, fp string, kept string, cell int"
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, PROSE, "en", "s", 3, "x", "y", "z", 4), (2, None, None, None, None, None, None, None, None)]):
        df = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns
            df = out
        assert corpus_pipeline.encode(spark, df, str(tmp_path)).count() == (1 if rows else 0)
    assert all(m is not None for m in (decontam, line_dedup, simhash))
