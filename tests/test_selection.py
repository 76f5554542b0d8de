import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import context, diffs, evidence, ordered, replay, repo
from reviewlake.operators.ordered import running
from reviewlake.plans import jobs
from reviewlake.streaming.state import VersionedState

from .test_repo_context_io import dealt_bytes

FILES = {"README.md": "about target\n", "src/a.py": "target = 1\nx = target\n", "src/core.py": "def target():\n    return 1\n", "src/z/deep.py": "no\n", "srcs.py": "target()\n", "ünï/é.py": "a\n"}
REQUEST = "review_id string, batch_id string, round int, seq int, commit_sha string, action string, path string, query string, start_line int, end_line int, done boolean"


def lines(spark, files=FILES):
    return spark.createDataFrame([("h", p, i, t) for p, text in files.items() for i, t in enumerate(text.splitlines(), 1)], "commit_sha string, path string, line_no int, text string")


def ask(action, path="", query="", start=None, end=None):
    return action, path, query, start, end


def normal(path):
    parts = path.split("/")
    return None if path.startswith("/") or ".." in parts or "\\" in path or "\0" in path else "/".join(x for x in parts if x not in ("", "."))


def found(action, path, query, start, end, limits, files=FILES):
    """What a request could show, by brute force: what ``replay.possible`` gives."""
    under = [p for p in sorted(files) if not path or p == path or p.startswith(path + "/")]
    out = {"rows": [], "more": False, "known": False, "n_lines": 0, "fault": None}
    if action == "list":
        after = [p for p in under if p > (query or "")]
        return out | {"rows": [{"path": p} for p in after[: limits.page]], "more": len(after) > limits.page}
    if action == "read":
        rows = files[path].splitlines() if path in files else []
        return out | {"rows": [{"path": path, "line_no": n, "text": rows[n - 1]} for n in range(start, min(end, len(rows)) + 1)], "known": path in files, "n_lines": len(rows)}
    hits = [{"path": p, "line_no": n, "text": t} for p in under for n, t in enumerate(files[p].splitlines(), 1) if query in t]
    at = (start or 1) - 1
    return out | {"rows": hits[at : at + limits.page], "more": len(hits) > at + limits.page, "known": bool(under)}


def fault(n, action, path, query, start, end, limits):
    if n >= limits.requests:
        return "too many requests"
    bad = normal(path) is None or {"read": not normal(path) or query or not start or not end or end < start, "search": not query or end, "list": query and not normal(query)}.get(action, True)
    return "bad" if bad else None


def served(rounds, limits=replay.Limits(), files=FILES, done=()):
    """Outcomes of each request of one batch, in order, and the evidence."""
    state, out = replay.Selection(limits, limits.context_chars), []
    for r, asks in enumerate(rounds):
        for n, (action, path, query, start, end) in enumerate(asks):
            error = fault(n, action, path, query, start, end, limits)
            path = path if error else normal(path)
            shown = {} if error else found(action, path, query, start, end, limits, files)
            out.append(state.take({"round": r, "done": r in done, "error": error, "action": action, "path": path, "query": query, "start_line": start, "end_line": end, **shown}))
    asked = [x for asks in rounds for x in asks]
    return out, "\n\n".join(o.text for o, x in zip(out, asked, strict=True) if o.outcome == "served" and x[0] != "list")


NOT_OFFERED = ("refused", "cursor was not offered")
said = lambda rows: [(r.outcome, r.reason) for r in rows]


def test_cursors_come_from_an_earlier_round():
    rows, ctx = served([[ask("search", query="target", start=100_000), ask("list", query="src/core.py")]])
    assert said(rows) == [NOT_OFFERED] * 2 and ctx == ""


def test_only_the_cursor_that_was_offered_last_is_served():
    page = replay.Limits(page=1)
    rows, _ = served([[ask("search", query="target"), ask("list")], [ask("search", query="target", start=3), ask("list", query="src/core.py")]], page)
    assert said(rows)[:2] == [("served", None)] * 2 and said(rows)[2:] == [NOT_OFFERED] * 2
    assert (rows[0].next_start, rows[1].next_cursor, rows[0].more, rows[1].shown) == (2, "README.md", True, 1)


def test_a_cursor_guessed_in_a_round_can_be_used_in_the_next():
    rounds = [[ask("search", query="target"), ask("search", query="target", start=2), ask("list"), ask("list", query="README.md")], [ask("search", query="target", start=2), ask("list", query="README.md")]]
    rows, _ = served(rounds, replay.Limits(page=1))
    assert said(rows) == [("served", None), NOT_OFFERED, ("served", None), NOT_OFFERED, ("served", None), ("served", None)]
    assert [r.shown for r in rows] == [1, 0, 1, 0, 1, 1] and rows[5].next_cursor == "src/a.py"


def test_first_pages_repeat_as_one_and_paths_take_their_normal_form():
    rows, _ = served([[ask("search", "src/", "target"), ask("search", "./src", "target", 1), ask("read", "src//a.py", "", 1, 1), ask("read", "src/a.py", "", 1, 1), ask("list", "."), ask("list", "")]])
    assert [r.outcome for r in rows] == ["served", "duplicate"] * 3 and rows[0].shown == 3
    rows, _ = served([[ask("read", "src\\a.py", "", 1, 1), ask("read", "/src/a.py", "", 1, 1), ask("read", "src/../a.py", "", 1, 1), ask("read", ".", "", 1, 1), ask("list", "a\0b"), ask("fly")]])
    assert {r.outcome for r in rows} == {"refused"}


def test_a_list_shows_no_file_and_a_prefix_is_a_folder_or_a_file():
    rows, ctx = served([[ask("list", "src"), ask("list", "srcs.py"), ask("list", "nope"), ask("search", "nope", "x")]])
    assert [r.shown for r in rows] == [3, 1, 0, 0] and not any(r.new_files for r in rows)
    assert rows[0].text == "UNTRUSTED INVENTORY LIST more=N prefix=src after=[start]\nsrc/a.py\nsrc/core.py\nsrc/z/deep.py" and rows[2].text.endswith("\n[no matching paths]")
    assert ctx == "UNTRUSTED LITERAL SEARCH\n[no matching paths]"


def test_files_have_places_and_known_ones_are_free():
    rows, ctx = served([[ask("read", "src/a.py", "", 1, 1), ask("search", "", "target"), ask("read", "src/core.py", "", 1, 1), ask("read", "src/a.py", "", 2, 9)]], replay.Limits(files=2))
    assert said(rows) == [("served", None), ("served", None), ("failed", "file limit"), ("served", None)]
    # README.md takes the second place; hits of src/a.py are free; those of others are passed over, and say that there is more
    assert (rows[1].shown, rows[1].more, rows[1].next_start, rows[1].new_files) == (3, True, 4, ["README.md"])
    assert rows[3].text.endswith("L2-L2\n      2 | x = target")


def test_room_rounds_and_the_end_of_a_selection():
    rows, ctx = served([[ask("read", "src/a.py", "", 1, 2), ask("read", "src/core.py", "", 1, 2), ask("list")]], replay.Limits(context_chars=90))
    assert [r.outcome for r in rows] == ["served", "served", "not reached"] and len(ctx) <= 92 and rows[2].reason == "no room"
    three = [[ask("list", "src")], [ask("list", "srcs.py")], [ask("list", "nope")]]
    assert [r.outcome for r in served(three)[0]] == ["served", "served", "not reached"]
    assert [r.reason for r in served(three, done={0})[0]] == [None, "selection is done", "selection is done"]
    assert [r.reason for r in served([[ask("list", str(i)) for i in range(10)]])[0]][8:] == ["too many requests"] * 2


def test_a_long_line_is_cut_and_the_next_page_goes_on():
    files = {"a.py": "needle " + "x" * 500 + "\n", "b.py": "needle\n"}
    limits = replay.Limits(read_chars=260)
    rows, _ = served([[ask("search", "", "needle")], [ask("search", "", "needle", 2)]], limits, files)
    assert len(rows[0].text) == 260 and rows[0].shown == 1 and rows[0].text.endswith("characters]") and rows[0].next_start == 2
    assert rows[1].shown == 1 and rows[1].text.endswith("b.py:1: needle") and not rows[1].more
    assert said(served([[ask("search", "", "needle")]], replay.Limits(read_chars=110), files)[0]) == [("failed", "no hit fits")]


def test_batches_on_spark_equal_the_state_alone(spark):
    rng, limits = random.Random(8), replay.Limits(page=2, files=3, read_chars=300, context_chars=700, requests=6)
    batches = []
    for _ in range(40):
        pool = [ask("search", rng.choice(["", "src/", "nope"]), "target", s) for s in (None, 1, 2, 3, 4)] + [ask("list", rng.choice(["", "src", "./src"]), q) for q in ("", "README.md", "src/a.py", "src/core.py", "a\\b")] + [ask("read", rng.choice([*FILES, "x", "/x"]), "", 1, rng.choice([0, 1, 5])) for _ in range(4)] + [ask("fly")]
        batches.append([[rng.choice(pool) for _ in range(rng.randrange(1, 8))] for _ in range(3)])
    rows = [(f"r{k}", "b", r, n, "h", *x, k % 9 == 0 and r == 0) for k, rounds in enumerate(batches) for r, asks in enumerate(rounds) for n, x in enumerate(asks)]
    tree = spark.createDataFrame([("h", p) for p in FILES], "commit_sha string, path string")
    out = jobs.serve_requests(spark.createDataFrame(rows, REQUEST).repartition(5), tree, lines(spark), limits)
    got = {}
    for r in out["outcomes"].orderBy("review_id", "round", "seq").collect():
        got.setdefault(r.review_id, []).append((r.outcome, r.shown, r.more, r.capped, r.next_start, r.next_cursor, r.new_files, r.text))
    context_of = {r.review_id: (r.context, r.files) for r in out["context"].collect()}
    for k, rounds in enumerate(batches):
        want, text = served(rounds, limits, done={0} if k % 9 == 0 else ())
        assert got[f"r{k}"] == [(o.outcome, o.shown, o.more, o.capped, o.next_start, o.next_cursor, o.new_files, o.text) for o in want]
        assert context_of.get(f"r{k}", ("", []))[0] == text and context_of.get(f"r{k}", ("", []))[1] == sorted({f for o in want for f in o.new_files})
    assert out["refused"].count() == sum(o[0] != "served" for os in got.values() for o in os) > 20


# literals, lists, prefixes


def test_literals_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["tes", "test", "ab", "a", "foo(x)", "é", "%_", "\\", "日本", " ", "xyzzy"]
    files = {f"d{i % 7}/f{i}.py": "\n".join("".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(12)) for i in range(60)}
    texts = [(p, i, t) for p, text in files.items() for i, t in enumerate(text.split("\n"), 1)]
    table = spark.createDataFrame([("h", *x) for x in texts], "commit_sha string, path string, line_no int, text string")
    asks = [(f"q{n}", "h", rng.choice(["", "d1", "d2/f2.py"]), (t := rng.choice(texts)[2] or "x")[(k := rng.randrange(len(t))) : k + rng.randrange(1, 51)]) for n in range(150)] + [("none", "h", "", "absent!"), ("long", "h", "", "z" * 60)]
    got = {(r.request_id, r.path, r.line_no) for r in repo.literal_hits(spark.createDataFrame(asks, "request_id string, commit_sha string, prefix string, query string"), table).collect()}
    under = lambda path, prefix: not prefix or path == prefix or path.startswith(prefix + "/")
    assert got == {(q, p, i) for q, _, prefix, query in asks for p, i, t in texts if query in t and under(p, prefix)}


def test_no_request_meets_lines_without_its_rarest_gram(spark):
    table = spark.createDataFrame([("h", f"f{i}", 1, "common words" if i else "common qz") for i in range(400)], "commit_sha string, path string, line_no int, text string")
    asked = spark.createDataFrame([("q", "h", "", "common qz")], "request_id string, commit_sha string, prefix string, query string")
    plan = repo.literal_hits(asked, table)
    assert [(r.path) for r in plan.collect()] == ["f0"]
    index = repo.gram_index(table).where("gram = 'n q'")
    assert index.count() == 1 and repo.gram_index(table.where("false")).count() == 0


@pytest.mark.parametrize(("compared", "rows"), [(0, 500_000), (0, 0), (1_000, 3)])
def test_more_queries_than_are_compared_meet_grams(spark, monkeypatch, compared, rows):
    monkeypatch.setattr(repo, "COMPARED", compared)
    monkeypatch.setattr(ordered, "FEW", rows)
    rng = random.Random(5)
    texts = [(f"d{i % 3}/f{i}.py", n, "".join(rng.choice(["tes", "ab", "a", "é", "%_", " ", "xyzzy"]) for _ in range(rng.randrange(0, 9)))) for i in range(20) for n in range(1, 9)]
    table = spark.createDataFrame([("h", *x) for x in texts], "commit_sha string, path string, line_no int, text string")
    asks = [(f"q{n}", "h", rng.choice(["", "d1"]), (t := rng.choice(texts)[2] or "x")[(k := rng.randrange(len(t))) : k + rng.randrange(1, 9)], rng.choice([None, 1, 2, 5])) for n in range(40)] + [("none", "h", "", "absent!", 1)]
    asked = spark.createDataFrame(asks, "request_id string, commit_sha string, prefix string, query string, start int")
    want = {q: sorted((p, i, t) for p, i, t in texts if query in t and (not prefix or p.startswith(prefix + "/"))) for q, _, prefix, query, _ in asks}
    assert {(r.request_id, r.path, r.line_no, r.text) for r in repo.literal_hits(asked, table).collect()} == {(q, *x) for q, hits in want.items() for x in hits}
    got = {(r.request_id, r.hit_no, r.path, r.line_no, r.text, r.more) for r in repo.literal_search(asked, table, page=2).collect()}
    assert got == {(q, n, *want[q][n - 1], len(want[q]) > (start or 1) + 1) for q, _, _, _, start in asks for n in range(start or 1, min((start or 1) + 2, len(want[q]) + 1))}


def test_served_searches_write_and_deal_out_less_than_the_text(spark):
    text = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400_000))
    table = lines(spark, {"src/a.ts": "\n".join(text[i : i + 4_000] for i in range(0, len(text), 4_000))})
    requests = spark.createDataFrame([("r", "b", 0, 0, "h", "search", "", text[123:130], None, None, None), ("r", "b", 0, 1, "h", "read", "src/a.ts", "", 2, 3, None)], REQUEST)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    bytes_of = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet")) + dealt_bytes(spark)
    before = bytes_of()
    got = jobs.serve_requests(requests, table.select("commit_sha", "path").distinct(), table, replay.Limits(read_chars=9_000, page=3))["outcomes"].orderBy("seq").collect()
    assert [(r.outcome, r.shown) for r in got] == [("served", 1), ("served", 2)] and text[123:130] in got[0].text and text[4_000:8_000] in got[1].text
    assert bytes_of() - before < len(text) / 2


@pytest.mark.parametrize("parts", [1, 9])
def test_lists_equal_brute_force(spark, parts):
    rng = random.Random(6)
    tree = sorted({(f"c{rng.randrange(3)}", "/".join(rng.choice(["a", "b", "a-b", "a.x", "é"]) for _ in range(rng.randrange(1, 5))) + f"/{rng.randrange(40)}") for _ in range(900)}) + [("c0", "a"), ("c0", "a/b")]
    asks = [(n, f"c{rng.randrange(4)}", rng.choice(["", "a", "a/b", "b", "a-b/a", "none", "a.x"]), rng.choice([None, "a/b", "a/a/3", "b/b", "zz", "a-b"])) for n in range(120)]
    out = repo.path_list(spark.createDataFrame(asks, "request_id int, commit_sha string, prefix string, cursor string"), spark.createDataFrame(tree * 2, "commit_sha string, path string").repartition(parts), page=7)
    got = {n: [] for n, *_ in asks}
    for r in out.orderBy("request_id", "place").collect():
        got[r.request_id].append((r.path, r.more, r.next_cursor))
    for n, c, prefix, cursor in asks:
        want = sorted(p for k, p in set(tree) if k == c and (not prefix or p == prefix or p.startswith(prefix + "/")) and p > (cursor or ""))
        assert got[n] == [(p, len(want) > 7, want[6] if len(want) > 7 else None) for p in want[:7]]


def test_an_index_keeps_room_for_its_marker(spark):
    paths = [f"src/file_{i}.py" for i in range(8)]
    tree = spark.createDataFrame([("h", p) for p in paths] + [("g", "a"), ("g", "b")], "commit_sha string, path string")
    got = {r["commit_sha"]: (r["index"], r["truncated"]) for r in repo.index_prefix(tree, 93).collect()}
    assert got["g"] == ("a\nb", False) and got["h"] == ("\n".join([*paths[:2], repo.INDEX_MARKER])[:93], True)
    assert repo.index_prefix(tree, 1000).where("truncated").count() == 0
    with pytest.raises(ValueError, match="61"):
        repo.index_prefix(tree, 60)


def test_running_sums_do_not_depend_on_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(1, 101)], "k int, v long")
    got = {r.k: r.s for r in running(rows.repartition(6), ["k"], {"s": "v"}, "sums").collect()}
    by = sorted((i * 7 % 101, i) for i in range(1, 101))
    assert got == {k: sum(v for _, v in by[: n + 1]) for n, (k, _) in enumerate(by)}


# evidence, exposure, one parse, versions


def test_every_anchor_is_shown_within_the_budget(spark):
    source = lines(spark, {f"f{i}.py": "\n".join(f"line {n} of {i} " + "x" * 60 for n in range(1, 101)) for i in range(20)})
    found = spark.createDataFrame([("r", i, "h", f"c{i}", "RIGHT", f"f{i}.py", 50, 100) for i in range(20)], "review_id string, seq int, commit_sha string, chunk_id string, side string, path string, line int, payload_chars int")
    patch = "\n".join(f"{'R' + str(n):>15} | +new {n} " + "y" * 50 for n in range(30, 70))
    chunks = found.select("review_id", "chunk_id", F.lit(patch).alias("annotated_patch"))
    contexts = found.select("review_id", "chunk_id", F.concat(F.lit("CTX "), F.col("seq") % 2, F.lit("z" * 900)).alias("context"))
    out = jobs.verifier_evidence(found, chunks, contexts, source, 4_000, 8_000)
    row = out["prompts"].first()
    assert len(row.prompt) <= 12_000 + 2 and row.prompt.startswith("<<<PATCH ") and "<<<END SOURCE " in row.prompt
    assert all(f"    50 | line 50 of {i} " in row.context for i in range(20)) and all(f"### candidate {i}: f{i}.py:50\n" in row.patch for i in range(20))
    assert row.patch.count("R50 | +new 50") == 20 and row.generation_blocks == row.generation_blocks_rendered == 2 and row.source_rendered < row.source_available
    assert row.context.index("### generation context: c0") < row.context.index("### RIGHT source")
    files = evidence.evidence_files(out["prompts"], out["placed"], found.select("review_id", "chunk_id", F.lit("other.py").alias("path")))
    got = {(r.kind, r.path): r.rendered for r in files.collect()}
    assert got[("source", "f3.py")] and not got[("generation", "other.py")] and len(got) == 21


@pytest.mark.parametrize("budget", [0, 30, 90, 400, 5_000])
def test_blocks_are_cut_around_their_anchors(budget):
    found = [{"index": i, "chunk_id": "c", "side": "LEFT", "path": "p", "line": 5 + i, "patch": "@@\n" + "\n".join(f"L{n} | -{'q' * n}" for n in range(1, 12)), "rows": [{"line_no": n, "text": "t" * n} for n in range(1, 12)]} for i in range(3)]
    made = dict(zip(evidence.NAMES, evidence.rendered(found, [{"index": 0, "chunk_id": "c", "context": "k" * 70}], budget, budget), strict=True))
    assert len(made["patch"]) <= budget and len(made["context"]) <= budget
    if budget >= 400:
        assert all(f"L{5 + i} | -{'q' * (5 + i)}" in made["patch"] and f"     {5 + i} | {'t' * (5 + i)}" in made["context"] for i in range(3))


def test_exposure_is_linear(spark):
    text = "\n".join(f"Path: p{i}.py\nSURROUNDING SOURCE:\n {i} | x\n### CONTEXT\nsee q{i}.py" for i in range(20_000))
    start = time.time()
    got = context.exposed_paths(spark.createDataFrame([("r", text)], "review_id string, context string")).count()
    assert got == 20_000 and time.time() - start < 30


def test_a_patch_is_parsed_once_for_all_results(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(raw):
        counted.add(1)
        return raw

    raws = [(str(i), f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -0,0 +1,2 @@\n+x\n+y\n") for i in range(30)]
    plan = jobs.plan_reviews(spark.createDataFrame(raws, "review_id string, raw string").select("review_id", seen.asNondeterministic()("raw").alias("raw")))
    for name in ("files", "hunks", "lines", "malformed", "chunks", "batches", "ledger", "violations"):
        plan[name].count()
    assert counted.value == 30


def test_text_behind_hunks_that_fits_nowhere_is_an_error(spark):
    raw = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1,1 @@\n+v\nrest " + "w" * 1000 + "\n"
    out = jobs.plan_reviews(spark.createDataFrame([("r", raw)], "review_id string, raw string"), chunk_chars=300)
    assert out["chunks"].count() == 0 and "cannot fit max_chars=300" in out["chunk_errors"].first().error
    assert jobs.plan_reviews(spark.createDataFrame([("r", raw)], "review_id string, raw string"), chunk_chars=2000)["chunks"].first().annotated_patch.endswith("w\n")


@pytest.mark.parametrize(
    ("header", "want"),
    [("a/old name b/new name", ("old name", "new name")), ('"a/t\\t" b/u', ("t\t", "u")), ("a/b b/b", ("b", "b")), ("x y", ("x", "y")), ("a/ b/ b/ b/", (" b/", " b/"))],
)
def test_headers_by_halves_tokens_and_prefixes(header, want):
    assert diffs.git_pair(header) == want


def test_versions_of_a_state(spark, tmp_path):
    state = VersionedState(spark, f"file://{tmp_path}/state", ("k",), lambda df: df.groupBy("k").agg(F.max("v").alias("v")), buckets=4)
    rows = lambda *kv: spark.createDataFrame(list(kv), "k int, v int")
    assert state.rows() is None and state.commit(0, rows(*[(i, 0) for i in range(50)])) and not state.commit(0, rows((1, 99)))
    for batch in range(1, 6):
        assert state.commit(batch, rows((batch, batch), (100 + batch, 1)))
    assert {r.k: r.v for r in state.rows().collect()} == {i: (i if 1 <= i <= 5 else 0) for i in range(50)} | {100 + b: 1 for b in range(1, 6)}
    # a read has a folder for each bucket, however many commits there were
    assert len(state.manifest()["buckets"]) == 4 and len(state._names(f"{state.folder}/manifests")) == 2
    before = state.manifest()
    state._publish = lambda manifest: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        state.commit(6, rows((1, 777)))
    again = VersionedState(spark, state.folder, ("k",), state.merged, 4)
    assert again.manifest() == before and again.rows().where("v = 777").count() == 0
    assert again.commit(6, rows((1, 777))) and again.rows().where("k = 1").first().v == 777 and again.commit(7, rows().limit(0))
