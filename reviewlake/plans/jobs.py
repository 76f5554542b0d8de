"""Composed jobs: planning, context, grounding, benchmark plans, export, judging, requests, verifier evidence."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_text, strip, wrap_untrusted
from ..operators import benchmark, context, diffs, evidence, export, findings, judge, repo, telemetry, verify
from ..operators.ordered import few, stored
from ..operators.replay import Limits, possible, replay, served_context


def plan_reviews(patches: DataFrame, chunk_chars: int = 36_000, batch_chars: int = 72_000) -> dict[str, DataFrame]:
    """patches (review_id, raw) to files with exclusions, chunk lines, chunks, batches, statistics and what keeps the plan from being whole.

    Patches are parsed once, and chunks are cut once: both are tables that the results read.
    """
    files, hunks, lines, malformed = diffs.tables(diffs.parsed_once(patches))
    files = diffs.classify_files(files, lines)
    rows, errors = diffs.pack_chunks(files, hunks, lines, chunk_chars)
    rows = stored(rows, "chunk_lines")
    made = diffs.chunks(rows, files, hunks, lines)
    return {
        "files": files, "hunks": hunks, "lines": lines, "malformed": malformed, "chunk_lines": rows, "chunk_errors": errors, "chunks": made, "batches": diffs.pack_batches(made, batch_chars),
        "ledger": diffs.changed_line_ledger(files, lines), "stats": diffs.diff_stats(patches, files, hunks, lines), "violations": diffs.check_partition(files, lines, rows),
    }


def build_context(
    chunks: DataFrame, lines: DataFrame, added: DataFrame | None = None, focus: DataFrame | None = None, budget: int = 36_000, max_symbols: int = 24, max_hits: int = 10, radius: int = 40, excerpt_chars: int = 24_000
) -> dict[str, DataFrame]:
    """Packets of chunks (review_id, chunk_id, commit_sha, path, added), with symbols, hits, hypotheses and the files that they show.

    lines: (commit_sha, path, line_no, text) of the repository. added: (review_id, chunk_id, path, line_index, new_line, content), what risks are
    sought in. focus: (review_id, chunk_id, line), around which source is shown. chunks may have a budget of their own and identity, a line on the review.
    A packet's budget says how many symbols are worth a search, and how many hits each; tests that no symbol found are added by their path, and the first
    imports of the chunk's file come with the hits. Of the lines, only those of the chunks' own files and those that are shown are written or dealt out.
    """
    have, key = set(chunks.columns), context.PACKET
    chunks = stored(chunks, "context_chunks")
    chunks = chunks.withColumns({"budget": (F.coalesce("budget", F.lit(budget)) if "budget" in have else F.lit(budget)).cast("long"), "identity": F.coalesce("identity", F.lit("")) if "identity" in have else F.lit("")})
    at = chunks.select(*key, "commit_sha", "path")
    file = ["commit_sha", "path"]
    own = stored(lines.join(few(at.select(*file).distinct()), file, "left_semi"), "own_lines")
    if focus is not None:
        excerpts = stored(context.source_excerpts(focus.select(*key, "line").join(at, key), own, radius, excerpt_chars), "excerpts")
        chunks = chunks.drop("source").join(excerpts.select(*key, "source"), key, "left")
    elif "source" not in have:
        chunks = chunks.withColumn("source", F.lit(None).cast("string"))
    found = stored(context.rank_symbols(chunks.withColumn("excerpt", F.col("source")), 1 << 30), "symbols")
    room = context.search_capacity(chunks.join(found.groupBy(*key).agg(F.count("*").alias("found")), key, "left").na.fill(0, ["found"]), max_symbols, max_hits)
    room = room.select(*key, "searchable_symbols", "hits_per_symbol", "evidence_rows")
    asked = found.join(room, key).where(F.col("rank") <= F.col("searchable_symbols"))
    hits = repo.symbol_lines(lines, asked.join(at.select(*key, "commit_sha"), key).select(*key, "commit_sha", "symbol", "hits_per_symbol"), max_hits).where(F.col("rank") <= F.col("hits_per_symbol"))
    hits = context.classify_hits(hits).select(*key, "kind", "symbol", "path", "line_no", "snippet").dropDuplicates([*key, "kind", "path", "line_no", "symbol"])
    imports = context.local_imports(own, max_hits).join(at, file).select(*key, F.lit("import").alias("kind"), F.lit("module").alias("symbol"), "path", "line_no", F.left(strip(F.col("text")), F.lit(400)).alias("snippet"))
    hits = hits.unionByName(imports.join(hits, [*key, "kind", "path", "line_no"], "left_anti"))
    tree = lines.select("commit_sha", "path").distinct()
    tests = stored(repo.related_tests(at.select(F.struct(*key).alias("review_id"), *file), tree, max_hits).select("review_id.*", F.col("test_path").alias("path")), "related_tests")
    heads = lines.where("line_no <= 6").join(few(at.select(*key, "commit_sha").join(tests, key).select(*file).distinct()), file, "left_semi")
    heads = heads.groupBy("commit_sha", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("snippet"))
    hits = context.with_tests(hits, tests.join(at.select(*key, "commit_sha"), key).join(heads, ["commit_sha", "path"]).select(*key, "path", "snippet"), max_hits)
    placed = context.interleave_hits(hits, key, ["path", "line_no", "symbol"], max_symbols * max_hits).drop("nth")
    risks = context.risk_hypotheses(added) if added is not None else None
    none = at.select(*key, F.lit("").alias("hypothesis_id"), "path", F.lit(0).alias("line"), F.lit("").alias("cue"), F.lit("").alias("question")).where("false")
    packets, rendered = context.packets(chunks, asked.select(*key, "symbol", "rank"), none if risks is None else risks, placed)
    packets = stored(packets, "packets")
    shown = context.exposed_paths(packets.select("review_id", F.col("packet").alias("context"))).select("review_id", "path")
    return {"symbols": asked.select(*key, "symbol", "score", "rank"), "hits": rendered, "packets": packets, "hypotheses": none if risks is None else risks, "files": telemetry.exposed_file_sets(shown, at.select("review_id", "path"))}


def ground_findings(responses: DataFrame, ledger: DataFrame, sources: DataFrame, decisions: DataFrame | None = None, min_confidence: float = 0.78) -> dict[str, DataFrame]:
    """responses to final findings and everything that was rejected, with stage and reason.

    Once a verifier batch of a review fails its checks, or a finding fits in none, that review has no final findings.
    """
    raw, bad = findings.parse_findings(responses)
    gated = stored(findings.gate_reasons(raw, ledger, sources), "gated")
    accepted, rejected = gated.where("reason is null"), gated.where("reason is not null")
    funnel = findings.rejection_funnel(gated.select(F.coalesce("stage", F.lit("accepted")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason")))
    if decisions is None:
        return {"final": accepted, "rejected": rejected, "bad_responses": bad, "funnel": funnel}
    sized = accepted.select("review_id", "seq", F.length(findings.render_candidate()).alias("payload_chars"))
    batches = stored(verify.verifier_batches(sized), "verifier_batches")
    sizes = batches.groupBy("review_id", "batch_offset").agg(F.count("*").alias("n"))
    closed = verify.fail_closed(verify.validate_decisions(decisions, sizes)).select("review_id", "batch_offset", F.col("outcome").alias("batch_outcome"))
    judged = verify.apply_decisions(batches.select("review_id", "seq", "batch_offset", "candidate_index"), decisions, min_confidence).join(closed, ["review_id", "batch_offset"])
    final_ids = judged.where("batch_outcome = 'final' and outcome = 'kept'").select("review_id", "seq")
    return {"final": accepted.join(final_ids, ["review_id", "seq"], "left_semi"), "rejected": rejected, "bad_responses": bad, "verifier": judged, "oversized": verify.oversized(sized), "funnel": funnel}


def plan_benchmark(golden: DataFrame, reviews: DataFrame, models: DataFrame, done: DataFrame, identity: list[str], preferred: str | None = None, text: str = "", limit: int | None = None) -> dict[str, DataFrame]:
    """Cases, their manifest, and the jobs that no completed artifact covers."""
    cases = benchmark.cases(golden, reviews, preferred)
    chosen = benchmark.filter_cases(cases, text, limit)
    return {"cases": cases, "manifest": benchmark.manifest(cases, golden), "jobs": benchmark.resume(benchmark.job_matrix(chosen, models), done, identity)}


def export_bundle(artifacts: DataFrame, cases: DataFrame, final: DataFrame, prior: DataFrame, tool: str, schema_version: str, ranges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates of one tool in place of its earlier ones, their groups, and the artifacts that were not eligible.

    artifacts: one row a review, with review_id, golden_url and tool; prior: rows of ``explode_candidates``. ranges: changed ranges of each (review_id, side,
    path), against which final findings are checked once more; one that fails keeps its whole review out.
    """
    checked = export.eligibility(artifacts, cases, schema_version)
    wrong = export.finding_violations(final, ranges) if ranges is not None else final.withColumn("reason", F.lit("")).where("false")
    wrong = stored(wrong, "finding_violations")
    sound = checked.where("reason is null").join(wrong.select("review_id").distinct(), "review_id", "left_anti")
    lists = export.export_candidates(sound.select("review_id", "golden_url", "tool"), final)
    rows = export.replace_tool(prior, export.explode_candidates(lists), tool)
    return {"reviews": lists, "candidates": rows, "groups": export.singleton_groups(rows), "refused": checked.where("reason is not null"), "violations": wrong, "counts": export.export_counts(rows)}


def verify_bundle(reviews: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Violations of an exported bundle; reviews: (golden_url, tool, candidates)."""
    return export.bundle_violations(reviews.select("golden_url", "tool", F.transform("candidates", lambda c: c["text"]).alias("texts")), candidates, groups)


def run_judge(golden: DataFrame, reviews: DataFrame, exported: DataFrame, groups: DataFrame | None = None, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None, threshold: float = 0.3) -> dict[str, DataFrame]:
    """Pairs, verdicts, evaluation of each review and metrics of each tool."""
    cands = judge.with_words(judge.candidates_or_comments(reviews, exported), "text", "text_words")
    verdicts = judge.score_pairs(judge.pairs(judge.with_words(golden, "comment", "comment_words"), cands), scorer, threshold)
    evaluations = judge.evaluate(golden, cands, verdicts, reviews.select("golden_url", "tool"), groups)
    return {"verdicts": verdicts, "evaluations": evaluations, "metrics": judge.metrics(evaluations)}


def serve_requests(requests: DataFrame, tree: DataFrame, lines: DataFrame, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """requests (review_id, batch_id, round, seq, commit_sha, action, path, query, start_line, end_line) to what became of each, and the evidence of each batch.

    Paths come in normal form; a page is served from the cursor that was offered last in an earlier round, and from no other; files, rounds and
    characters have limits. done and seed_chars of requests, and bytes and is_binary of tree, count where they are there.
    """
    checked = repo.validate_requests(requests, limits.requests, limits.read_lines, limits.max_offset).withColumn("request_id", F.concat_ws("/", "review_id", "batch_id", "round", "seq"))
    checked = stored(checked, "requests")
    found = possible(checked, tree, lines, limits, paths=stored(repo.path_table(tree), "paths"))
    outcomes = stored(replay(found, limits), "outcomes")
    return {"outcomes": outcomes, "context": served_context(outcomes), "refused": outcomes.where("outcome <> 'served'")}


def verifier_evidence(found: DataFrame, chunks: DataFrame, contexts: DataFrame, lines: DataFrame, patch_budget: int = 72_000, context_budget: int = 48_000) -> dict[str, DataFrame]:
    """Patch and context of each verifier batch, every block cut around its finding's line to its share, and the prompt of both within the two budgets.

    found: (review_id, seq, commit_sha, chunk_id, side, path, line, payload_chars); chunks: (review_id, chunk_id, annotated_patch); contexts: (review_id, chunk_id, context).
    """
    placed = verify.verifier_batches(found.select("review_id", "seq", "payload_chars")).select("review_id", "seq", "batch_offset", "candidate_index")
    placed = stored(placed.join(found.drop("payload_chars"), ["review_id", "seq"]), "placed")
    # both are framed, with a mark of 64 digits at most on either side
    frame = lambda label: 2 * (len(label) + 64 + 16)
    made = stored(evidence.batch_evidence(placed, chunks, contexts, lines, max(0, patch_budget - frame("PATCH")), max(0, context_budget - frame("SOURCE"))), "evidence")
    framed = F.concat(wrap_untrusted("PATCH", F.col("patch")), F.lit("\n\n"), wrap_untrusted("SOURCE", F.col("context")))
    return {"prompts": made.withColumn("prompt", framed), "placed": placed, "oversized": verify.oversized(found)}


def build_prompts(batches: DataFrame, template: str, cap: int) -> DataFrame:
    """batches (review_id, batch_id, patch, context) with prompt: the template's {patch} and {context} filled, the context alone clipped to fit cap."""
    before, rest = template.split("{patch}")
    between, after = rest.split("{context}")
    framed = F.length(wrap_untrusted("CONTEXT", F.lit(""))) + 2 * 48  # a longer token may be needed
    # a column for each step, so that no text is framed or cut more than once
    rows = batches.withColumn("_patch", wrap_untrusted("PATCH", F.col("patch")))
    rows = rows.withColumn("_room", F.greatest(F.lit(0), F.lit(cap - len(before) - len(between) - len(after)) - F.length("_patch") - framed).cast("int"))
    rows = rows.withColumn("_context", clip_text(F.col("context"), F.col("_room"), "context"))
    rows = rows.withColumn("prompt", F.concat(F.lit(before), "_patch", F.lit(between), wrap_untrusted("CONTEXT", F.col("_context")), F.lit(after)))
    return rows.drop("_patch", "_room", "_context")
