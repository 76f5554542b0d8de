"""Benchmark runs: cases, fixtures, job matrix, resume, records and comparable sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import bench_pr_url, case_id
from ..functions.text import json_hash


def pick_fixtures(reviews: DataFrame, preferred: str | None = None) -> DataFrame:
    """One review (golden_url, tool, pr_url, repo_name) for each case: the preferred tool's, else the least."""
    order = F.struct((F.col("tool") != F.lit(preferred)).alias("other") if preferred else F.lit(True).alias("other"), "tool", "pr_url", "repo_name")
    best = reviews.groupBy("golden_url").agg(F.min(order).alias("b"))
    return best.select("golden_url", F.col("b.tool").alias("fixture_tool"), F.col("b.pr_url").alias("review_url"), F.col("b.repo_name").alias("fixture_repo_name"))


def golden_hashes(golden: DataFrame) -> DataFrame:
    """(golden_url, golden_sha256): digest of a case's golden issues in order. Cases hash apart, so no task holds all."""
    rows = golden.groupBy("golden_url").agg(F.array_sort(F.collect_list(F.struct("golden_index", "category", "comment", "severity"))).alias("g"))
    return rows.select("golden_url", json_hash(F.transform("g", lambda x: F.struct(x["category"].alias("category"), x["comment"].alias("comment"), x["severity"].alias("severity")))).alias("golden_sha256"))


def golden_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Golden rows on one side alone, with the side: empty if nothing changed."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def cases(golden: DataFrame, reviews: DataFrame, preferred: str | None = None) -> DataFrame:
    """(case_id, golden_url, review_url, repository, pr_number, fixture_tool, fixture_repo_name, golden_sha256)."""
    pr = bench_pr_url(F.col("golden_url"))
    rows = pick_fixtures(reviews, preferred).join(golden_hashes(golden), "golden_url")
    return rows.select(case_id(F.col("golden_url")).alias("case_id"), "golden_url", "review_url", F.concat(pr.owner, F.lit("/"), pr.repo).alias("repository"), pr.number.alias("pr_number"), "fixture_tool", "fixture_repo_name", "golden_sha256")


def manifest(case_table: DataFrame, golden: DataFrame) -> DataFrame:
    """(fixture_tool, cases, golden_issues), and their totals with a null tool."""
    n = golden.groupBy("golden_url").agg(F.count("*").alias("issues"))
    return case_table.join(n, "golden_url", "left").rollup("fixture_tool").agg(F.count("*").alias("cases"), F.coalesce(F.sum("issues"), F.lit(0)).alias("golden_issues"))


def filter_cases(case_table: DataFrame, text: str = "", limit: int | None = None) -> DataFrame:
    """Cases with the text in one of five fields, whatever the case of letters, in order of their golden address."""
    fields = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in ("case_id", "golden_url", "review_url", "repository", "fixture_tool")]
    hit = fields[0]
    for f in fields[1:]:
        hit = hit | f
    rows = case_table.where(hit).orderBy("golden_url")
    return rows if limit is None else rows.limit(limit)


def job_matrix(case_table: DataFrame, models: DataFrame) -> DataFrame:
    """Each case with each model (of a short list, which is checked and broadcast)."""
    if models.count() > 10_000:
        raise ValueError("more models than a job matrix takes")
    return case_table.crossJoin(F.broadcast(models))


def identity(*columns: str):
    """One digest of all fields that must be equal for a job to be done."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def resume(jobs: DataFrame, done: DataFrame, columns: list[str]) -> DataFrame:
    """Jobs without a completed artifact that is equal in all identity columns."""
    d = done.where("status = 'completed'").select(identity(*columns).alias("_id")).distinct()
    return jobs.withColumn("_id", identity(*columns)).join(d, "_id", "left_anti").drop("_id")


def queue(jobs: DataFrame, size: str = "diff_chars") -> DataFrame:
    """Largest first, then by case and model. The order is the result; no position is numbered in one task."""
    return jobs.orderBy(F.desc(size), "case_id", "model")


def latest_records(records: DataFrame, order: list[str], key: tuple[str, ...] = ("model", "case_id")) -> DataFrame:
    """The last record of each key; later columns of order break ties."""
    value = F.struct(*[c for c in records.columns if c not in key])
    last = records.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias("r"))
    return last.select(*key, "r.*")


def semantic_digest(diffs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(review_id, semantic_sha256): what a diff says, whatever its text: merge base, numbers of files, hunks and lines, and the changed ranges of each side and path.

    diffs: (review_id, merge_base_sha, additions, deletions, files, hunks), null where one is missing; ledger: (review_id, side, path, ranges), of
    ``diffs.ledger_arrays``.
    """
    ranges = ledger.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("side", "path", "ranges"))).alias("ranges"))
    fields = ("merge_base_sha", "additions", "deletions", "files", "hunks")
    rows = diffs.join(ranges, "review_id", "left")
    whole = F.forall(F.array(*[F.col(c).isNotNull() for c in (*fields, "ranges")]), lambda x: x) & (F.col("merge_base_sha") != "")
    return rows.select("review_id", F.when(whole, F.sha2(F.to_json(F.struct(*fields, "ranges")), 256)).alias("semantic_sha256"))


def sweep_violations(artifacts: DataFrame) -> DataFrame:
    """(case_id, reason): what keeps artifacts (model, case_id, golden_url, review_url, base_sha, head_sha, diff_sha256, semantic_sha256) of several models from being compared.

    Each model has each case once, with no field missing. In each case a model has the identity of the first model by name, and its diff, by the text's digest or, if
    both have one, by ``semantic_digest``. One model alone has nothing to be compared with.
    """
    rows = artifacts if "semantic_sha256" in artifacts.columns else artifacts.withColumn("semantic_sha256", F.lit(None).cast("string"))
    models = rows.agg(F.count_distinct("model").alias("n"), F.min("model").alias("first")).first()
    if models.n < 2:
        return rows.select("case_id", F.lit("").alias("reason")).where("false")
    needed = ("golden_url", "review_url", "base_sha", "head_sha", "diff_sha256")
    missing = F.exists(F.array(F.col("case_id").cast("string"), *[F.col(c).cast("string") for c in needed]), lambda x: x.isNull() | (x == ""))
    own = rows.groupBy("model", "case_id").agg(F.count("*").alias("n"), F.bool_or(missing).alias("missing"), *[F.min(c).alias(c) for c in (*needed, "semantic_sha256")])
    base = own.where(F.col("model") == models["first"]).select("case_id", F.struct(*needed[:4]).alias("_identity"), F.col("diff_sha256").alias("_diff"), F.col("semantic_sha256").alias("_semantic"))
    rows = own.join(base, "case_id", "left")
    same_diff = (F.col("diff_sha256") == F.col("_diff")) | F.coalesce(F.col("semantic_sha256") == F.col("_semantic"), F.lit(False))
    by = rows.groupBy("case_id").agg(
        F.bool_or("missing").alias("missing"), F.max("n").alias("most"), F.count("*").alias("models"), F.bool_or(~F.coalesce(F.struct(*needed[:4]) == F.col("_identity"), F.lit(False))).alias("moved"), F.bool_or(~F.coalesce(same_diff, F.lit(False))).alias("changed"),
    )
    reason = (
        F.when(F.col("missing"), "artifact lacks an identity").when(F.col("most") > 1, "several artifacts for a case").when(F.col("models") < models.n, "case is missing for a model")
        .when(F.col("moved"), "snapshots differ").when(F.col("changed"), "diffs differ")
    )
    return by.withColumn("reason", reason).where("reason is not null").select("case_id", "reason")


def manifest_violations(expected: DataFrame, records: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """(model, case_id, reason) where records are not exactly one completed run, with an artifact of its own and of the right digest, for each job.

    contents: (artifact, sha256), as read from the files.
    """
    key = ["model", "case_id"]
    by = records.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and(F.col("status").isin("completed", "resumed")).alias("ok"), F.min("artifact").alias("artifact"), F.min("artifact_sha256").alias("sha"))
    shared = by.groupBy("artifact").agg(F.count("*").alias("owners"))
    rows = expected.select(*key, F.lit(True).alias("wanted")).join(by, key, "full").join(shared, "artifact", "left")
    wrong = F.lit(False)
    if contents is not None:
        rows = rows.join(contents, "artifact", "left")
        wrong = ~F.coalesce(F.col("sha") == F.col("sha256"), F.lit(False))
    reason = (
        F.when(F.col("wanted").isNull(), "unexpected record").when(F.col("n").isNull(), "missing record").when(F.col("n") > 1, "several records").when(~F.col("ok"), "not completed")
        .when(F.col("owners") > 1, "artifact is shared").when(wrong, "checksum differs")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*key, "reason")


# Characters a token stands for, tokens kept for the protocol and characters for framing; the smallest window and envelope; budgets without a window.
CHARS_PER_TOKEN, PROTOCOL_TOKENS, FRAMING_CHARS = 2, 4_096, 12_000
LEAST_WINDOW, LEAST_EVIDENCE = 16_384, 16_384
FIXED_BUDGETS = {"patch_chars": 72_000, "context_chars": 120_000, "context_files": 16, "requests_per_round": 8, "read_chars": 24_000, "search_hits": 12, "index_chars": 60_000}
SEED_CHARS = 36_000


def derive_budgets(models: DataFrame) -> DataFrame:
    """models (window_tokens, output_tokens, directed) with the budgets of a review and error.

    A null window has the fixed budgets; the others share out what a declared window leaves beside the answer. directed
    tells whether the model chooses its context, and so gets a smaller seed. A column ``set_`` before a budget's name holds
    values that go before the derived ones, where they are neither null nor 0. What can't be had has an error and null budgets.
    """
    w = F.col("window_tokens")
    given = lambda name, v: F.coalesce(F.nullif(F.col(f"set_{name}"), F.lit(0)), v) if f"set_{name}" in models.columns else v
    within = lambda low, v, high: F.greatest(F.lit(low), F.least(F.lit(high), v))
    part = lambda v, by: F.floor(v / by)
    rows = models.withColumn("max_output_tokens", F.when(w.isNull(), F.col("output_tokens")).otherwise(F.least("output_tokens", F.greatest(F.lit(2_048), part(w, 4)))))
    rows = rows.withColumn("_left", w - F.col("max_output_tokens") - PROTOCOL_TOKENS).withColumn("input_chars", F.col("_left") * CHARS_PER_TOKEN).withColumn("_evidence", F.col("input_chars") - FRAMING_CHARS)
    of = lambda name, v: given(name, F.when(w.isNull(), F.lit(FIXED_BUDGETS[name])).otherwise(v).cast("long"))
    rows = rows.withColumn("patch_chars", of("patch_chars", F.greatest(F.lit(8_192), part(F.col("_evidence") * 2, 5))))
    rows = rows.withColumn("context_chars", of("context_chars", F.greatest(F.lit(8_192), F.col("_evidence") - F.col("patch_chars"))))
    c = F.col("context_chars")
    seed = F.least(F.lit(SEED_CHARS), c, F.when(F.col("directed"), F.greatest(F.lit(4_000), part(c, 3))).otherwise(c))
    rows = rows.withColumn("seed_chars", F.coalesce(F.col("set_seed_chars"), seed) if "set_seed_chars" in models.columns else seed)
    rows = rows.withColumn("context_files", of("context_files", within(4, part(c, 8_000), 64)))
    rows = rows.withColumns({
        "requests_per_round": of("requests_per_round", within(4, part(F.col("context_files") + 1, 2), 16)), "read_chars": of("read_chars", within(4_000, part(c, 4), 48_000)),
        "search_hits": of("search_hits", within(6, F.col("context_files"), 24)), "index_chars": of("index_chars", within(8_000, part(c, 2), 120_000)),
    })
    error = (
        F.when(w < LEAST_WINDOW, "window is too small").when(F.col("_left") <= 0, "no room for input").when(F.col("_evidence") < LEAST_EVIDENCE, "no room for patch and context")
        .when(F.col("seed_chars") > c, "seed is larger than the context")
    )
    rows = rows.withColumn("error", error)
    made = ("max_output_tokens", "input_chars", *FIXED_BUDGETS, "seed_chars")
    return rows.withColumns({n: F.when(F.col("error").isNull(), F.col(n).cast("long")) for n in made}).drop("_left", "_evidence")
