"""Benchmark runs and telemetry: cases, jobs, records, sweeps, coverage, usage, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark, diffs, export, repo, telemetry
from . import views as V


def _fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Each customer is a case, each of its orders a review of a tool."""
    return V.table(spark, d, "orders").select(F.col("o_custkey").alias("golden_url"), F.col("o_orderpriority").alias("tool"), F.concat(F.lit("u"), F.col("o_orderkey")).alias("pr_url"), F.col("o_orderstatus").alias("repo_name"))


def fixture_pick(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.pick_fixtures(_fixtures(spark, d), "3-MEDIUM")


def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    golden = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("golden_url"))
    return benchmark.manifest(benchmark.pick_fixtures(_fixtures(spark, d)), golden).na.fill("all", ["fixture_tool"])


def golden_hashes(spark: SparkSession, d: str) -> DataFrame:
    golden = V.golden(spark, d).select("golden_url", "golden_index", "comment", F.lit("low").alias("severity"), F.lit(None).cast("string").alias("category"))
    return benchmark.golden_hashes(golden)


def golden_changes(spark: SparkSession, d: str) -> DataFrame:
    b = V.table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))
    after = b.where("item_id % 10 <> 3").withColumn("sha", F.when(F.col("item_id") % 10 == 4, "changed").otherwise(F.col("sha")))
    return benchmark.golden_changes(b, after)


def case_filter(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_name").alias("golden_url"), F.lit("r").alias("review_url"), F.lit(None).cast("string").alias("repository"), F.lit("T").alias("fixture_tool"))
    return benchmark.filter_cases(c, "R#00000001").select("case_id", "golden_url")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    models = V.table(spark, d, "region").select(F.concat(F.lit("model-"), "r_regionkey").alias("model"))
    cases = V.table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("config"))
    return benchmark.job_matrix(cases, models)


def job_matrix_resume(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    done = o.select(F.concat(F.lit("model-"), F.col("o_orderkey") % 5).alias("model"), F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 25).alias("config"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return benchmark.resume(_jobs(spark, d), done, ["model", "case_id", "config"])


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    jobs = V.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("diff_chars"))
    return benchmark.queue(jobs)


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.latest_records(V.records(spark, d), ["committed_at", "o_orderkey"]).select("model", "case_id", "status", "o_orderkey")


def run_status(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.run_status(benchmark.latest_records(V.records(spark, d), ["committed_at", "o_orderkey"]))


def sweep_comparable(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each priority and customer as an artifact; identities, texts and meanings of diffs differ here and there, some lack a field, some come twice."""
    k = F.col("k")
    rows = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 300).alias("case_id")).agg(F.min("o_orderkey").alias("k"))
    rows = rows.select(
        "model", "case_id", F.when(k % 50 == 0, "g2").otherwise("g").alias("golden_url"), F.lit("r").alias("review_url"), F.when(k % 61 != 0, "b").alias("base_sha"), F.lit("h").alias("head_sha"), F.when(k % 20 == 1, "d2").otherwise("d").alias("diff_sha256"),
        F.when(k % 40 == 1, "s2").when(k % 33 != 0, "s").alias("semantic_sha256"), "k",
    )
    return benchmark.sweep_violations(rows.unionByName(rows.where("k % 67 = 0")).drop("k"))


def semantic_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Digests of what the diffs of suppliers change, by merge base, counts and ranges; some have no merge base."""
    led = diffs.ledger_arrays(V.ledger(spark, d))
    counts = V.ledger(spark, d).groupBy("review_id").agg(F.count_distinct("path").alias("files"), F.count_if(F.col("side") == "RIGHT").alias("additions"), F.count_if(F.col("side") == "LEFT").alias("deletions"))
    rows = counts.select("review_id", F.when(F.col("review_id") % 7 != 0, "m").alias("merge_base_sha"), "additions", "deletions", "files", F.col("files").alias("hunks"))
    return benchmark.semantic_digest(rows, led).select("review_id", F.coalesce("semantic_sha256", F.lit("")).alias("semantic_sha256"))


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    expected = V.table(spark, d, "customer").select(F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))).alias("model"), F.col("c_custkey").alias("case_id"))
    artifact = F.concat("o_orderpriority", F.lit("/a"), F.col("o_custkey") % 400)
    rec = o.select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "failed").otherwise("completed").alias("status"), artifact.alias("artifact"), F.concat(F.lit("x"), F.col("o_custkey") % 50).alias("artifact_sha256"))
    contents = rec.select("artifact").distinct().withColumn("sha256", F.concat(F.lit("x"), F.element_at(F.split("artifact", "/a"), -1).cast("int") % 50))
    return benchmark.manifest_violations(expected, rec, contents.where("not endswith(artifact, '7')"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return export.duplicates(V.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").groupBy("n").agg(F.count("*").alias("keys"))


def artifact_gates(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts out of orders, with something wrong or missing at every so many keys, against cases out of customers."""
    k = F.col("o_orderkey")
    at = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    url = lambda c: F.concat(F.lit("g"), c)
    a = V.table(spark, d, "orders").select(
        at(19, None, F.lit("v1")).alias("schema_version"), at(23, "0", F.lit("1")).alias("tool_version"), at(29, None, F.lit("s")).alias("suite"), F.when(F.col("o_orderstatus") == "O", "failed").otherwise("completed").alias("status"),
        url(F.col("o_custkey")).alias("golden_url"), at(31, None, F.lit("s")).alias("golden_sha256"), at(37, F.lit(0), F.col("o_custkey")).alias("case_id"), at(41, None, F.lit("r")).alias("review_url"), F.lit("t").alias("fixture_tool"),
        at(43, None, F.lit("r")).alias("pr_url"), at(47, F.lit("abc"), F.sha2(k.cast("string"), 256)).alias("base_sha"), F.sha2(k.cast("string"), 256).alias("head_sha"), at(53, None, F.lit(True)).alias("coverage_complete"), at(59, False, F.lit(True)).alias("chunk_plan_complete"),
        at(61, "[]", F.lit("{}")).alias("config_json"), F.lit("{}").alias("context_json"), F.lit("{}").alias("runtime_json"), at(67, None, F.lit("[]")).alias("findings_json"), F.col("o_orderpriority").alias("model"),
    )
    cases = V.table(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("case_id"), url(F.col("c_custkey")).alias("golden_url"), F.lit("s").alias("golden_sha256"), F.lit("r").alias("review_url"), F.lit("t").alias("fixture_tool"))
    return export.eligibility(a, cases, "v1", {"tool_version": "1", "suite": "s"}).groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def one_configuration(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("tool"), F.col("o_orderstatus").alias("config_json"))
    return export.one_configuration(o)


def hunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("review_id"), (F.col("l_orderkey") % 40).alias("hunk_id"), (F.col("l_orderkey") % 120).alias("chunk_id"))
    hunks = li.select("review_id", "hunk_id").distinct().unionByName(V.table(spark, d, "nation").select((F.col("n_nationkey") + 1_000_000).alias("review_id"), F.lit(None).cast("long").alias("hunk_id")))
    done = li.where("chunk_id % 17 <> 0 or review_id % 5 = 0").select("review_id", "chunk_id")
    out = telemetry.review_status(telemetry.hunk_coverage(hunks, li.distinct(), done).withColumn("fatal", F.col("review_id") % 7 == 0))
    return out.select("review_id", "eligible_hunks", "completed_hunks", "failed_hunks", "complete", F.round("coverage_ratio", 9).alias("coverage_ratio"), "status")


def call_usage(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.call_usage(V.calls(spark, d)).select("stage", "calls", "reporting", "tokens", "missing", "errors", F.round("latency_ms", 2).alias("latency_ms"))


def call_usage_hourly(spark: SparkSession, d: str) -> DataFrame:
    rows = V.calls(spark, d).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH"))
    return telemetry.call_usage(rows, "hour", "stage").select("hour", "stage", "calls", "reporting", "tokens", "errors")


def last_usage(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events are a stream of one call; one in three has no usage, and fields have two names."""
    e = V.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    name = F.when(F.col("event_id") % 2 == 0, "input_tokens").otherwise("prompt_tokens")
    payload = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"usage": {"'), name, F.lit('": '), k, F.lit(', "completion_tokens": 2.0}}')))
    out = telemetry.last_usage(e.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), payload.alias("payload")))
    return out.select("call_id", "input_tokens", "output_tokens", F.coalesce("cached_input_tokens", F.lit(0).cast("long")).alias("cached_input_tokens"))


def latency_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of latency by stage, to three digits, where each stage has few enough calls to rank exactly."""
    rows = V.calls(spark, d).withColumn("group", F.floor(F.col("review_id") / 10))
    q = telemetry.latency_quantiles(rows, "stage", "group")
    return q.select("stage", "group", *[F.round(F.get("latency_ms", F.lit(i)), 3).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


def context_pressure(spark: SparkSession, d: str) -> DataFrame:
    rows = V.items(spark, d).select(F.col("conv_id").alias("review_id"), F.least("n", F.lit(400)).alias("used"), F.lit(400).alias("budget"), (F.col("n") > 400).alias("truncated"))
    return telemetry.context_pressure(rows).withColumn("max_utilisation", F.round("max_utilisation", 9))


def context_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = V.items(spark, d).select(F.col("conv_id").alias("review_id"), "text", F.col("role").alias("kind"), F.when(F.col("n") > 800, "too long").alias("omitted_reason"))
    return telemetry.context_totals(rows, ["assistant", "user"])


def omissions(spark: SparkSession, d: str) -> DataFrame:
    rows = V.items(spark, d).select((F.col("conv_id") % 10).alias("review_id"), F.when(F.col("n") > 800, "too long").when(F.col("n") < 60, "too short").alias("omitted_reason"))
    return telemetry.omissions(rows)


def file_sets(spark: SparkSession, d: str) -> DataFrame:
    f = V.src_files(spark, d).select(F.col("commit_sha").alias("review_id"), "path", "doc_id")
    return telemetry.exposed_file_sets(f.where("doc_id % 3 <> 0").select("review_id", "path"), f.where("doc_id % 2 = 0").select("review_id", "path"))


def selection_telemetry(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.col("user_id").alias("review_id"), F.lit("b").alias("batch_id"), F.when(k % 3 == 0, "list").when(k % 3 == 1, "read").otherwise("search").alias("action"),
        F.when(k % 5 == 0, "rejected").when(k % 5 == 1, "omitted").when(k % 5 == 2, "deduplicated").otherwise("accepted").alias("outcome"), k.alias("lines"), (k % 4).alias("hits"),
    )
    return telemetry.selection_telemetry(rows)


def pages_left(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("review_id"), F.lit("b").alias("batch_id"), F.col("event_type").alias("path"), F.lit("q").alias("query"), (F.col("event_id") % 3).alias("round"), F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("long") % 2 == 0).alias("more"))
    return telemetry.pages_left(rows)


def budget_derivation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    m = V.table(spark, d, "customer").select("c_custkey", F.when(k % 10 != 0, k * 131 % 200_000).alias("window_tokens"), (k * 17 % 9_000 + 1).alias("output_tokens"), (k % 3 == 0).alias("directed"), F.when(k % 17 == 0, k % 100_000).alias("set_patch_chars"))
    names = ("max_output_tokens", "input_chars", *benchmark.FIXED_BUDGETS, "seed_chars")
    return benchmark.derive_budgets(m).select("c_custkey", F.coalesce("error", F.lit("")).alias("error"), *[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in names])


def file_lists(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a commit that a listing of everything does not reach in its first page."""
    tree = V.src_files(spark, d).select("commit_sha", "path")
    req = tree.select("commit_sha").distinct().select(F.col("commit_sha").alias("request_id"), "commit_sha", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("cursor"))
    page = repo.path_list(req, tree, page=10).select(F.col("request_id").alias("commit_sha"), "path")
    return tree.distinct().exceptAll(page).groupBy("commit_sha").agg(F.count("*").alias("unreached"))


QUERIES = {
    f.__name__: f
    for f in (
        fixture_pick, dataset_manifest, golden_hashes, golden_changes, case_filter, job_matrix_resume, work_queue, latest_records, run_status, sweep_comparable, semantic_diffs, manifest_check, duplicate_ids, artifact_gates, one_configuration, hunk_coverage,
        call_usage, call_usage_hourly, last_usage, latency_bounds, context_pressure, context_totals, omissions, file_sets, selection_telemetry, pages_left, budget_derivation, file_lists,
    )
}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_LATEST = f"WITH {V.V4}, l AS (SELECT *, row_number() OVER (PARTITION BY model, case_id ORDER BY committed_at DESC, o_orderkey DESC) AS r FROM records)"
ORACLE = {
    "fixture_pick": """SELECT golden_url, tool AS fixture_tool, pr_url AS review_url, repo AS fixture_repo_name FROM (SELECT o_custkey AS golden_url, o_orderpriority AS tool, 'u' || o_orderkey AS pr_url, o_orderstatus AS repo,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '3-MEDIUM', o_orderpriority, 'u' || o_orderkey, o_orderstatus) AS r FROM orders) WHERE r = 1""",
    "dataset_manifest": """WITH c AS (SELECT o_custkey AS k, min(o_orderpriority) AS t, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY 1) SELECT coalesce(t, 'all') AS fixture_tool, count(*) AS cases, CAST(sum(n) AS BIGINT) AS golden_issues FROM c GROUP BY ROLLUP (t)""",
    "golden_hashes": f"""WITH {V.V6} SELECT golden_url, sha256('[' || string_agg('{{"category":null,"comment":' || to_json(comment) || ',"severity":"low"}}', ',' ORDER BY golden_index) || ']') AS golden_sha256 FROM g GROUP BY golden_url""",
    "golden_changes": """SELECT item_id, sha256(text) AS sha, 'before' AS side FROM benchmark WHERE item_id % 10 IN (3, 4) UNION ALL SELECT item_id, 'changed', 'after' FROM benchmark WHERE item_id % 10 = 4""",
    "case_filter": "SELECT c_custkey::VARCHAR AS case_id, c_name AS golden_url FROM customer WHERE contains(lower(c_name), 'r#00000001') OR contains(c_custkey::VARCHAR, 'r#00000001')",
    "job_matrix_resume": """SELECT case_id, config, model FROM (SELECT c_custkey AS case_id, c_nationkey AS config, 'model-' || r_regionkey AS model FROM customer CROSS JOIN region) j
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey = case_id AND 'model-' || (o_orderkey % 5) = model AND o_orderkey % 25 = config)""",
    "work_queue": "SELECT o_custkey AS case_id, o_orderpriority AS model, o_totalprice AS diff_chars FROM orders",
    "latest_records": f"{_LATEST} SELECT model, case_id, status, o_orderkey FROM l WHERE r = 1",
    "run_status": f"{_LATEST} SELECT status, count(*) AS records FROM l WHERE r = 1 GROUP BY status",
    "sweep_comparable": """WITH k AS (SELECT o_orderpriority AS model, o_custkey % 300 AS case_id, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), f AS (SELECT min(model) AS first, count(DISTINCT model) AS n FROM k),
      r AS (SELECT model, case_id, k, k % 50 = 0 AS g, k % 20 = 1 AS d, CASE WHEN k % 40 = 1 THEN 's2' WHEN k % 33 <> 0 THEN 's' END AS s FROM k),
      j AS (SELECT r.*, b.k AS bk, b.g AS bg, b.d AS bd, b.s AS bs FROM r LEFT JOIN r b ON b.case_id = r.case_id AND b.model = (SELECT first FROM f)),
      c AS (SELECT case_id, bool_or(k % 61 = 0) AS missing, bool_or(k % 67 = 0) AS twice, count(*) AS m, bool_or(bk IS NULL OR coalesce(bk % 61 = 0, true) OR k % 61 = 0 OR g <> bg) AS moved, bool_or(bk IS NULL OR (d <> bd AND NOT coalesce(s = bs, false))) AS changed FROM j GROUP BY case_id)
      SELECT * FROM (SELECT case_id, CASE WHEN missing THEN 'artifact lacks an identity' WHEN twice THEN 'several artifacts for a case' WHEN m < (SELECT n FROM f) THEN 'case is missing for a model' WHEN moved THEN 'snapshots differ' WHEN changed THEN 'diffs differ' END AS reason FROM c) WHERE reason IS NOT NULL""",
    "semantic_diffs": f"""WITH {V.V5}, i AS (SELECT review_id, side, path, min(line) AS s, max(line) AS e FROM (SELECT *, line - row_number() OVER (PARTITION BY review_id, side, path ORDER BY line) AS g FROM ledger WHERE line > 0) GROUP BY review_id, side, path, g),
      p AS (SELECT review_id, side, path, '{{"side":"' || side || '","path":"' || path || '","ranges":[' || string_agg('{{"start":' || s || ',"end":' || e || '}}', ',' ORDER BY s) || ']}}' AS j FROM i GROUP BY review_id, side, path),
      a AS (SELECT review_id, string_agg(j, ',' ORDER BY side, path) AS j FROM p GROUP BY review_id), c AS (SELECT review_id, count(DISTINCT path) AS f, count(*) FILTER (WHERE side = 'RIGHT') AS a, count(*) FILTER (WHERE side = 'LEFT') AS d FROM ledger GROUP BY review_id)
      SELECT review_id, CASE WHEN review_id % 7 = 0 THEN '' ELSE sha256('{{"merge_base_sha":"m","additions":' || c.a || ',"deletions":' || d || ',"files":' || f || ',"hunks":' || f || ',"ranges":[' || j || ']}}') END AS semantic_sha256 FROM c JOIN a USING (review_id)""",
    "manifest_check": """WITH r AS (SELECT o_orderpriority AS model, o_custkey AS k, count(*) AS n, bool_and(o_orderstatus <> 'O') AS ok FROM orders GROUP BY 1, 2), s AS (SELECT model, k % 400 AS a, count(*) AS owners FROM r GROUP BY 1, 2),
      e AS (SELECT model, c_custkey FROM customer, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS model))
      SELECT * FROM (SELECT coalesce(e.model, r.model) AS model, coalesce(c_custkey, r.k) AS case_id, CASE WHEN c_custkey IS NULL THEN 'unexpected record' WHEN n IS NULL THEN 'missing record' WHEN n > 1 THEN 'several records' WHEN NOT ok THEN 'not completed' WHEN owners > 1 THEN 'artifact is shared'
        WHEN r.k % 400 % 10 = 7 THEN 'checksum differs' END AS reason FROM e FULL JOIN r ON r.k = c_custkey AND r.model = e.model LEFT JOIN s ON s.model = r.model AND s.a = r.k % 400) WHERE reason IS NOT NULL""",
    "duplicate_ids": "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1 GROUP BY n",
    "artifact_gates": """WITH a AS (SELECT *, o_orderkey AS k, count(*) OVER (PARTITION BY o_orderpriority, o_custkey) AS n, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON c_custkey = o_custkey)
      SELECT CASE WHEN k % 19 = 0 THEN 'unsupported schema' WHEN k % 23 = 0 THEN 'tool_version is not the expected one' WHEN k % 29 = 0 THEN 'suite is not the expected one' WHEN o_orderstatus = 'O' THEN 'not completed' WHEN NOT known THEN 'unknown case'
        WHEN n > 1 THEN 'several artifacts for a case' WHEN k % 31 = 0 THEN 'golden issues have changed' WHEN k % 37 = 0 THEN 'case id is not the case''s' WHEN k % 41 = 0 THEN 'review is not the case''s fixture' WHEN k % 43 = 0 THEN 'pull request is not the fixture''s'
        WHEN k % 47 = 0 THEN 'base_sha is not exact' WHEN k % 53 = 0 THEN 'coverage is not complete' WHEN k % 59 = 0 THEN 'chunk plan is not complete' WHEN k % 61 = 0 THEN 'config is missing' WHEN k % 67 = 0 THEN 'findings are missing' ELSE '' END AS reason, count(*) AS n FROM a GROUP BY 1""",
    "one_configuration": "SELECT o_custkey AS tool, count(DISTINCT o_orderstatus) AS configurations FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    "hunk_coverage": """WITH h AS (SELECT l_suppkey AS review_id, l_orderkey % 40 AS hunk_id, bool_and(l_orderkey % 120 % 17 <> 0 OR l_suppkey % 5 = 0) AS done FROM lineitem GROUP BY 1, 2),
      r AS (SELECT review_id, count(*) AS e, count(*) FILTER (WHERE done) AS c FROM h GROUP BY 1 UNION ALL SELECT n_nationkey + 1000000, 0, 0 FROM nation)
      SELECT review_id, e AS eligible_hunks, c AS completed_hunks, e - c AS failed_hunks, e = c AS complete, CASE WHEN e = 0 THEN 1.0 ELSE round(CAST(c AS DOUBLE) / e, 9) END AS coverage_ratio,
        CASE WHEN review_id % 7 = 0 THEN 'failed' WHEN e = c THEN 'completed' WHEN c > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""",
    "call_usage": f"WITH {V.V3} SELECT stage, count(*) AS calls, count(input_tokens) AS reporting, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS tokens, count(*) - count(input_tokens) AS missing, count(error) AS errors, round(sum(latency_ms), 2) AS latency_ms FROM calls GROUP BY stage",
    "call_usage_hourly": f"WITH {V.V3} SELECT strftime(ts, '%Y-%m-%d %H') AS hour, stage, count(*) AS calls, count(input_tokens) AS reporting, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS tokens, count(error) AS errors FROM calls GROUP BY ALL",
    "last_usage": f"SELECT user_id AS call_id, arg_max({_K}, event_id) AS input_tokens, CAST(2 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cached_input_tokens FROM events WHERE event_id % 3 <> 0 GROUP BY user_id",
    "latency_bounds": f"WITH {V.V3} SELECT stage, review_id // 10 AS \"group\", round(quantile_disc(latency_ms, 0.5), 3) AS p50, round(quantile_disc(latency_ms, 0.9), 3) AS p90, round(quantile_disc(latency_ms, 0.99), 3) AS p99 FROM calls GROUP BY 1, 2",
    "context_pressure": """SELECT conv_id AS review_id, count(*) AS batches, count(*) FILTER (WHERE length(text) > 400) AS truncated_batches, count(*) FILTER (WHERE least(length(text), 400) / 400.0 >= 0.95) AS near_limit,
      round(max(least(length(text), 400) / CAST(400 AS DOUBLE)), 9) AS max_utilisation, bool_or(length(text) > 400) AS hit_limit FROM conversations GROUP BY conv_id""",
    "context_totals": """SELECT conv_id AS review_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens, count(*) FILTER (WHERE length(text) > 800) AS omitted,
      count(*) FILTER (WHERE role = 'assistant' AND length(text) <= 800) AS assistant, count(*) FILTER (WHERE role = 'user' AND length(text) <= 800) AS user FROM conversations GROUP BY conv_id""",
    "omissions": "SELECT conv_id % 10 AS review_id, CASE WHEN length(text) > 800 THEN 'too long' ELSE 'too short' END AS omitted_reason, count(*) AS n FROM conversations WHERE length(text) > 800 OR length(text) < 60 GROUP BY ALL",
    "file_sets": """SELECT source AS review_id, count(*) FILTER (WHERE doc_id % 3 <> 0) AS exposed_files, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0) AS changed_files, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 2 <> 0) AS cross_files,
      count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 2 = 0) AS omitted_files FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0 GROUP BY source""",
    "selection_telemetry": f"""WITH e AS (SELECT user_id, {_K} AS k FROM events) SELECT user_id AS review_id, 'b' AS batch_id, count(*) AS requested, count(*) FILTER (WHERE k % 5 > 2) AS accepted, count(*) FILTER (WHERE k % 5 = 0) AS rejected, count(*) FILTER (WHERE k % 5 = 1) AS omitted,
      count(*) FILTER (WHERE k % 5 = 2) AS deduplicated, count(*) FILTER (WHERE k % 5 > 2 AND k % 3 = 0) AS list_actions, count(*) FILTER (WHERE k % 5 > 2 AND k % 3 = 1) AS read_actions, count(*) FILTER (WHERE k % 5 > 2 AND k % 3 = 2) AS search_actions,
      CAST(sum(k) AS BIGINT) AS lines, CAST(sum(k % 4) AS BIGINT) AS hits FROM e GROUP BY user_id""",
    "pages_left": f"""WITH e AS (SELECT user_id, event_type, arg_max({_K} % 2 = 0, (event_id % 3) * 100000000000 + event_id) AS more FROM events GROUP BY ALL) SELECT user_id AS review_id, 'b' AS batch_id, count(*) FILTER (WHERE more) AS unresolved FROM e GROUP BY user_id""",
    # from the documented rules: 4,096 tokens for the protocol, 2 characters a token, 12,000 for framing, two fifths of the rest for patches
    "budget_derivation": """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 131 % 200000 END AS w, c_custkey * 17 % 9000 + 1 AS o, c_custkey % 3 = 0 AS directed, CASE WHEN c_custkey % 17 = 0 THEN nullif(c_custkey % 100000, 0) END AS sp FROM customer),
      a AS (SELECT *, CASE WHEN w IS NULL THEN o ELSE least(o, greatest(2048, w // 4)) END AS mo FROM m), i AS (SELECT *, (w - mo - 4096) * 2 AS ic FROM a), e AS (SELECT *, ic - 12000 AS ev FROM i),
      p AS (SELECT *, coalesce(sp, CASE WHEN w IS NULL THEN 72000 ELSE greatest(8192, CAST(floor(ev * 2 / 5) AS BIGINT)) END) AS pc FROM e), c AS (SELECT *, CASE WHEN w IS NULL THEN 120000 ELSE greatest(8192, ev - pc) END AS cc FROM p),
      f AS (SELECT *, CASE WHEN w IS NULL THEN 16 ELSE greatest(4, least(64, cc // 8000)) END AS cf, least(36000, cc, CASE WHEN directed THEN greatest(4000, cc // 3) ELSE cc END) AS sc,
        CASE WHEN w < 16384 THEN 'window is too small' WHEN w - mo - 4096 <= 0 THEN 'no room for input' WHEN ev < 16384 THEN 'no room for patch and context' ELSE '' END AS error FROM c)
      SELECT c_custkey, error, CASE WHEN error = '' THEN mo ELSE -1 END::BIGINT AS max_output_tokens, coalesce(CASE WHEN error = '' THEN ic ELSE -1 END, -1)::BIGINT AS input_chars, CASE WHEN error = '' THEN pc ELSE -1 END::BIGINT AS patch_chars,
        CASE WHEN error = '' THEN cc ELSE -1 END::BIGINT AS context_chars, CASE WHEN error = '' THEN cf ELSE -1 END::BIGINT AS context_files, CASE WHEN error <> '' THEN -1 WHEN w IS NULL THEN 8 ELSE greatest(4, least(16, (cf + 1) // 2)) END::BIGINT AS requests_per_round,
        CASE WHEN error <> '' THEN -1 WHEN w IS NULL THEN 24000 ELSE greatest(4000, least(48000, cc // 4)) END::BIGINT AS read_chars, CASE WHEN error <> '' THEN -1 WHEN w IS NULL THEN 12 ELSE greatest(6, least(24, cf)) END::BIGINT AS search_hits,
        CASE WHEN error <> '' THEN -1 WHEN w IS NULL THEN 60000 ELSE greatest(8000, least(120000, cc // 2)) END::BIGINT AS index_chars, CASE WHEN error = '' THEN sc ELSE -1 END::BIGINT AS seed_chars FROM f""",
    "file_lists": "SELECT source AS commit_sha, count(*) - 10 AS unreached FROM documents GROUP BY source HAVING count(*) > 10",
}
