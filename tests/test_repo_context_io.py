import hashlib
import json

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import context, ordered, repo, telemetry
from reviewlake.plans import jobs
from reviewlake.sources import files
from reviewlake.streaming import jobs as streams

FILES = {
    "src/service.ts": "import { persist } from './store'\nexport function processItems(xs) {\n  xs.forEach(async x => persist(x))\n}\n",
    "src/store.ts": "export function persist(x) {\n  return db.query(`insert ${x}`)\n}\n",
    "src/caller.ts": "import { processItems } from './service'\nprocessItems([1])\n",
    "tests/service.test.ts": "processItems([])\n",
}


def lines(spark):
    rows = [("h", p, i, t) for p, text in FILES.items() for i, t in enumerate(text.splitlines(), 1)]
    return spark.createDataFrame(rows, "commit_sha string, path string, line_no int, text string")


CHUNK = "review_id string, chunk_id string, commit_sha string, path string, added string"
ADDED = "export function processItems(xs) {\n  xs.forEach(async x => persist(x))\n}"


def test_context_ranks_and_stays_in_budget(spark):
    chunk = spark.createDataFrame([("r", "c", "h", "src/service.ts", ADDED)], CHUNK)
    focus = spark.createDataFrame([("r", "c", 2)], "review_id string, chunk_id string, line int")
    added = spark.createDataFrame([("r", "c", "src/service.ts", i, i + 2, x) for i, x in enumerate(ADDED.split("\n"))], "review_id string, chunk_id string, path string, line_index int, new_line int, content string")
    whole = jobs.build_context(chunk, lines(spark), added, focus)
    assert [r.symbol for r in whole["symbols"].orderBy("rank").limit(2).collect()] == ["processItems", "persist"]
    kinds = {(r.kind, r.path) for r in whole["hits"].where("symbol = 'processItems'").collect()}
    assert kinds == {("definition", "src/service.ts"), ("import", "src/caller.ts"), ("caller", "src/caller.ts"), ("test", "tests/service.test.ts")}
    packet = whole["packets"].first().packet
    order = ["CONTEXT FOR DIFF CHUNK c", "Path: src/service.ts", "Selected symbols: processItems, persist", "RISK HYPOTHESES:", "- HYPOTHESIS src/service.ts:3: forEach", "SURROUNDING SOURCE:\n    1 | import", "    3 |   xs.forEach", "RANKED REPOSITORY EVIDENCE:", "- DEFINITION processItems", "- IMPORT"]
    assert [packet.index(x) for x in order] == sorted(packet.index(x) for x in order)
    f = whole["files"].first()
    assert (f.changed_files, f.exposed_files) == (1, 1 + f.cross_files) and f.cross_files >= 2
    small = jobs.build_context(chunk, lines(spark), added, focus, budget=900)
    row = small["packets"].first()
    assert len(row.packet) <= 900 and row.rows_rendered + row.rows_omitted == row.rows_available > row.rows_rendered > 0 and not row.packet_cut
    again = jobs.build_context(chunk.repartition(3), lines(spark).repartition(7), added, focus, budget=900)["packets"].first()
    assert again == row
    assert jobs.build_context(chunk, lines(spark), budget=0)["packets"].first().packet == ""


def dealt_bytes(spark):
    """Bytes that the stages of the session have written to be dealt out."""
    gateway = spark.sparkContext._gateway
    every = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(every.apply(i).shuffleWriteBytes() for i in range(every.size()))


def test_lines_are_not_copied_for_each_token(spark):
    names = [f"x{hashlib.sha256(str(i).encode()).hexdigest()[:12]}" for i in range(4_000)]
    long = spark.createDataFrame([("h", "src/long.ts", 1, " ".join(names))], "commit_sha string, path string, line_no int, text string")
    chunk = spark.createDataFrame([("r", "c", "h", "src/service.ts", f"{names[7]}(processItems)")], CHUNK)
    before = dealt_bytes(spark)
    packet = jobs.build_context(chunk, lines(spark).unionByName(long))["packets"].first()
    assert f"CALL SITE {names[7]}" not in packet.packet and f"USAGE {names[7]} — src/long.ts:1: {names[0]}" in packet.packet
    assert dealt_bytes(spark) - before < 2_000_000  # the line has 56,000 characters


def test_symbols_in_lines_equal_those_of_an_index(spark, monkeypatch):
    wanted = spark.createDataFrame([("r", "h", "processItems"), ("s", "h", "persist"), ("s", "h", "x"), ("s", "g", "x")], "review_id string, commit_sha string, symbol string")
    rows = lambda df: sorted(tuple(r[c] for c in ("review_id", "symbol", "path", "line_no", "text", "rank")) for r in df.collect())
    want = rows(repo.symbol_search(repo.token_index(lines(spark)), wanted, 2))
    assert len(want) == 6 and rows(repo.symbol_lines(lines(spark), wanted, 2)) == want
    monkeypatch.setattr(ordered, "FEW", 0)
    assert rows(repo.symbol_lines(lines(spark), wanted, 2)) == want


def test_tests_that_no_symbol_found_come_by_their_path(spark):
    chunk = spark.createDataFrame([("r", "c", "h", "src/service.ts", "zzz_unknown(1)")], CHUNK)
    hits = jobs.build_context(chunk, lines(spark))["hits"].where("kind = 'test'").collect()
    assert [(r.symbol, r.path, r.line_no, r.snippet) for r in hits] == [("path-match", "tests/service.test.ts", 1, "processItems([])")]


def test_risk_cues_need_script_suffix_and_no_promise_all(spark):
    rows = [("r", "c1", "a.ts", 1, 7, "xs.forEach( async x => 1)"), ("r", "c1", "a.ts", 2, 8, "db.execute(f'{x}')"), ("r", "c2", "a.py", 1, 7, "xs.forEach(async x)"), ("r", "c3", "b.js", 1, 1, "await Promise.all(ys.map(async y => y))"), ("r", "c4", "b.js", 1, 3, "ys.map(async y => y)")]
    got = context.risk_hypotheses(spark.createDataFrame(rows, "review_id string, chunk_id string, path string, line_index int, new_line int, content string"))
    assert {(r.hypothesis_id, r.line) for r in got.collect()} == {("c1:risk:00", 7), ("c1:risk:01", 8), ("c4:risk:00", 3)}


def test_pages_follow_one_another(spark):
    req = spark.createDataFrame([("q", "h", "", "(", n) for n in (1, 3, 5)], "request_id string, commit_sha string, prefix string, query string, start int").withColumn("request_id", F.concat("request_id", "start"))
    got = repo.literal_search(req, lines(spark), page=2)
    seen = [(r.path, r.line_no) for r in got.orderBy("request_id", "hit_no").collect()]
    assert seen == sorted((p, i) for p, t in FILES.items() for i, x in enumerate(t.splitlines(), 1) if "(" in x)[: len(seen)] and len(set(seen)) == len(seen) == 6


def test_coverage_without_hunks_is_whole(spark):
    h = spark.createDataFrame([("r", None), ("s", "h1"), ("s", "h2")], "review_id string, hunk_id string")
    c = spark.createDataFrame([("s", "c1", "h1"), ("s", "c2", "h1")], "review_id string, chunk_id string, hunk_id string")
    d = spark.createDataFrame([("s", "c1"), ("s", "c2")], "review_id string, chunk_id string")
    got = {r.review_id: r for r in telemetry.review_status(telemetry.hunk_coverage(h, c, d).withColumn("fatal", F.lit(False))).collect()}
    assert got["r"].coverage_ratio == 1.0 and got["r"].status == "completed" and got["s"].status == "partial" and got["s"].failed_hunks == 1


def test_prompts_fit(spark):
    b = spark.createDataFrame([("r", "b", "patch", "c" * 5000)], "review_id string, batch_id string, patch string, context string")
    assert 800 < len(jobs.build_prompts(b, "A {patch} B {context} C", 1200).first().prompt) <= 1200


def test_benchmark_file_and_artifacts(spark, tmp_path):
    url = "https://github.com/o/r/pull/1"
    entry = {"pr_title": "t", "source_repo": "s", "golden_source_file": "g", "golden_comments": [{"comment": "c1", "severity": "low", "category": None}], "reviews": [{"tool": "t", "repo_name": "n", "pr_url": "p", "review_comments": [{"path": "a", "line": 1, "body": "b", "created_at": "z"}]}]}
    (tmp_path / "b.json").write_text(json.dumps({url: entry, "nope": entry, url[:-1] + "2": {**entry, "golden_comments": []}, url[:-1] + "3": {**entry, "golden_comments": [{"comment": " "}]}}))
    golden, reviews, bad = files.read_benchmark(spark, str(tmp_path / "b.json"))
    assert golden.count() == 1 and reviews.first().review_comments[0].body == "b" and bad.count() == 3
    art = {"schema_version": "v1", "config": {"model": "m"}, "benchmark": {"case_id": "c"}, "findings": [{"title": "x", "line": 3}, {"title": "y"}], "calls": []}
    (tmp_path / "a.json").write_text(json.dumps(art, indent=1))
    a = files.read_artifacts(spark, str(tmp_path / "a.json"))
    assert [(r.model, r.seq, r.title) for r in files.exploded(a, "findings").orderBy("seq").collect()] == [("m", 0, "x"), ("m", 1, "y")] and files.exploded(a, "calls").first().stage is None
    (tmp_path / "n.json").write_text(json.dumps({"u": {"t": [[0, 1], [2]]}}))
    assert files.read_nested(spark, str(tmp_path / "n.json"), "array<array<int>>").first().value == [[0, 1], [2]]
    df = spark.createDataFrame([("u", "t", "x"), ("u", "s", "y")], "golden_url string, tool string, v string")
    assert json.loads(files.nested_json(df, "v").first().json) == {"t": "x", "s": "y"}
    files.write_bundle(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("tool = 's'").count() == 1


def test_repository_files_are_safe_text(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1\n")
    (root / "big").write_text("x" * 100)
    (root / "bin").write_bytes(b"a\x00b")
    got = files.read_repo_files(spark, str(root), str(root), "h", cap=50).collect()
    assert [(r.path, r.content) for r in got] == [("src/a.py", "x = 1\n")]


def test_a_zero_byte_is_found_behind_halves_of_others(spark, tmp_path):
    # "0\n" and " \n" are 300A and 200A in hexadecimal digits, whose 00 is no zero byte
    for name, content in (("text", b"10\n2 \n"), ("digit", b"10\n\0"), ("blank", b"2 \nx\0y"), ("first", b"\0"), ("ten", b"\x10\x01")):
        (tmp_path / name).write_bytes(content)
    assert {r.path for r in files.read_repo_files(spark, str(tmp_path), str(tmp_path), "h").collect()} == {"text", "ten"}


def test_records_stream_equals_batch(spark, tmp_path):
    schema = "model string, case_id string, status string, n long"
    plan = spark.createDataFrame([("m", "a"), ("m", "b")], "model string, case_id string")
    for i, rows in enumerate([[("m", "a", "failed", 1), ("x", "a", "completed", 2)], [("m", "a", "completed", 3), ("m", "b", "failed", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = streams.upsert_records(stream, str(tmp_path / "state"), str(tmp_path / "ck"), plan, ["n"])
        q.awaitTermination(60)
    got = {(r.model, r.case_id, r.status) for r in streams.records_state(spark, str(tmp_path / "state"), ["n"]).collect()}
    assert got == {("m", "a", "completed"), ("m", "b", "failed")}


@pytest.mark.parametrize("name", ["once", "hourly", "pending"])
def test_streams_over_files(spark, tmp_path, name):
    rows = [("k1", "2024-01-01 00:10:00", "gen", 5), ("k1", "2024-01-01 00:20:00", "gen", None), ("k2", "2024-01-01 01:10:00", "ver", 7)]
    df = spark.createDataFrame(rows, "marker string, ts string, stage string, input_tokens long").withColumn("ts", F.to_timestamp("ts")).withColumn("error", F.lit(None).cast("string"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    if name == "once":
        out, mode = streams.publish_once(stream), "append"
    elif name == "hourly":
        out, mode = streams.hourly_usage(stream), "complete"
    else:
        done = spark.createDataFrame([("k1", "gen", 0)], "golden_url string, tool string, errors_count int")
        out, mode = streams.pending_evaluations(stream.select(F.col("marker").alias("golden_url"), F.col("stage").alias("tool")), done), "append"
    q = out.writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table(f"s_{name}")
    if name == "once":
        assert sorted(r.marker for r in got.collect()) == ["k1", "k2"]
    elif name == "hourly":
        assert sorted((r.stage, r.calls, r.reporting, r.tokens) for r in got.collect()) == [("gen", 2, 1, 5), ("ver", 1, 1, 7)]
    else:
        assert [(r.golden_url, r.tool) for r in got.collect()] == [("k2", "ver")]


def test_budgets_capacity_and_exposure_by_hand(spark):
    from reviewlake.operators import benchmark, verify

    rows = [(1, None, 100, False), (2, 65_536, 32_768, True), (3, 16_000, 100, False), (4, 16_384, 9_000, False), (5, 65_536, 32_768, False)]
    got = {r.k: r for r in benchmark.derive_budgets(spark.createDataFrame(rows, "k int, window_tokens long, output_tokens long, directed boolean")).collect()}
    assert (got[1].patch_chars, got[1].context_chars, got[1].seed_chars, got[1].context_files, got[1].input_chars) == (72_000, 120_000, 36_000, 16, None)
    # 65,536 - 16,384 - 4,096 tokens are 90,112 characters; 78,112 after framing
    assert (got[2].max_output_tokens, got[2].input_chars, got[2].patch_chars, got[2].context_chars, got[2].seed_chars) == (16_384, 90_112, 31_244, 46_868, 15_622)
    assert (got[2].context_files, got[2].requests_per_round, got[2].read_chars, got[2].search_hits, got[2].index_chars) == (5, 4, 11_717, 6, 23_434)
    assert (got[3].error, got[3].patch_chars) == ("window is too small", None) and got[4].error == "no room for patch and context" and got[5].seed_chars == 36_000
    caps = {r.budget: (r.evidence_budget, r.evidence_rows, r.searchable_symbols, r.hits_per_symbol) for r in context.search_capacity(spark.createDataFrame([(300,), (1000,), (36_000,)], "budget int")).collect()}
    assert caps == {300: (1, 0, 0, 0), 1000: (260, 2, 2, 3), 36_000: (10_760, 112, 24, 5)}
    text = "Path: my a.py\nwhy\nSURROUNDING SOURCE:\n  3 | x\n### CONTEXT 2\nPath: b.py\n### CONTEXT 3\nSURROUNDING SOURCE:\n 1 | x\nsee c.py\n- USAGE f — d e.py:7\nf.py:9: x\n### LEFT source: g.py:1-2\nno rows"
    shown = context.exposed_paths(spark.createDataFrame([("r", text)], "review_id string, context string"))
    assert {r.path for r in shown.collect()} == {"my a.py", "d e.py", "f.py"}
    only = spark.createDataFrame([("r", "f.py"), ("r", "b.py"), ("q", "d e.py")], "review_id string, path string")
    assert {r.path for r in context.exposed_paths(spark.createDataFrame([("r", text)], "review_id string, context string"), only).collect()} == {"f.py"}
    blocks = [("a", 0, "context", 0, 500), ("a", 0, "source", 1, 500), ("b", 0, "context", 0, 10), ("b", 0, "source", 1, 500), ("b", 0, "source", 2, 30), ("c", 0, "source", 0, 80), ("c", 0, "source", 1, 80), ("c", 0, "source", 2, 7)]
    out = verify.evidence_shares(spark.createDataFrame(blocks, "review_id string, batch_offset int, kind string, seq int, chars int"), 100)
    assert {(r.review_id, r.seq): r.allocation for r in out.collect()} == {("a", 0): 49, ("a", 1): 49, ("b", 0): 10, ("b", 1): 56, ("b", 2): 30, ("c", 0): 45, ("c", 1): 44, ("c", 2): 7}


def test_missing_values_fail_their_gates(spark):
    from reviewlake.operators import export

    cases = spark.createDataFrame([("c", "g", "s", "r", "t")], "case_id string, golden_url string, golden_sha256 string, review_url string, fixture_tool string")
    good = {"model": "m", "schema_version": "v1", "status": "completed", "coverage_complete": True, "case_id": "c", "golden_url": "g", "golden_sha256": "s", "review_url": "r", "fixture_tool": "t", "base_sha": "a" * 40, "config_json": "{}", "pr_url": "r"}
    rows = [good, *({**good, k: None} for k in good if k != "model")]
    schema = ", ".join(f"{k} {'boolean' if k == 'coverage_complete' else 'string'}" for k in good)
    got = [export.eligibility(spark.createDataFrame([tuple(r.values())], schema), cases, "v1").first().reason for r in rows]
    assert got[0] is None and all(got[1:])
