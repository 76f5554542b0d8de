"""Judge: metrics, running best, rollup, paired arms, groups, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_space
from ..operators import export, judge
from . import views as V


def _evaluations(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    c = V.candidates(spark, d, whole)
    return judge.evaluate(V.golden(spark, d, whole), c, V.verdicts(spark, d, whole), c.select("golden_url", "tool"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"})


def judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(judge.metrics(_evaluations(spark, d, whole=True)))


def judge_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_evaluations(spark, d, whole=True))


def judge_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(judge.metrics(_evaluations(spark, d, whole=True), "tool", "golden_url", rollup=True).na.fill("all", ["tool", "golden_url"]))


def judge_running_best(spark: SparkSession, d: str) -> DataFrame:
    best = judge.running_best(V.verdicts(spark, d, whole=True).where("match")).where("improves")
    return best.select("golden_url", "tool", "golden_index", "candidate_index", "pair_seq", F.round("confidence", 9).alias("confidence"))


def judge_siblings(spark: SparkSession, d: str) -> DataFrame:
    c = V.candidates(spark, d)
    groups = c.select("golden_url", "tool", F.floor(F.col("candidate_index") / 3).alias("group_index"), "candidate_index")
    out = judge.siblings(c.select("golden_url", "tool", "candidate_index", "text"), groups)
    return out.groupBy("golden_url", "tool").agg(F.count("*").alias("links"), F.count_distinct("text").alias("texts"))


def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(judge.paired_deltas(_evaluations(spark, d, whole=True), "user", "assistant"))


def judge_resume(spark: SparkSession, d: str) -> DataFrame:
    e = _evaluations(spark, d, whole=True).withColumn("errors_count", F.when(F.col("fp") % 2 == 0, 0).otherwise(1))
    return judge.resume(e.select("golden_url", "tool"), e, force=["user"])


def judge_queue(spark: SparkSession, d: str) -> DataFrame:
    e = _evaluations(spark, d)
    return judge.work_queue(e.select("golden_url", "tool", (F.col("total_golden") * F.col("total_candidates")).alias("n_pairs")))


def candidate_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = V.candidates(spark, d)
    lists = c.groupBy("golden_url", "tool").agg(F.array_sort(F.collect_list(F.struct("candidate_index", "text"))).alias("l"))
    reviews = lists.select("golden_url", "tool", F.transform("l", lambda x: x["text"]).alias("comments"))
    odd = F.substring("golden_url", 6, 9).cast("int") % 2 == 1
    exported = reviews.where(odd).select("golden_url", "tool", F.when(F.col("tool") == "user", F.array().cast("array<string>")).otherwise(F.filter("comments", lambda x: F.length(x) > 400)).alias("texts"))
    out = judge.candidates_or_comments(reviews, exported)
    return out.groupBy("golden_url", "tool").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    return V.candidates(spark, d).select("golden_url", "tool", "candidate_index", F.sha2("text", 256).alias("text_sha256"))


def bundle_replace(spark: SparkSession, d: str) -> DataFrame:
    old = _bundle(spark, d)
    new = old.where((F.col("tool") == "user") & (F.col("candidate_index") % 2 == 0)).withColumn("text_sha256", F.sha2("text_sha256", 256))
    return export.merge_prior(export.replace_tool(old.where("golden_url <> 'case-3'"), new.where("golden_url <> 'case-5'"), "user"), old)


def bundle_verify(spark: SparkSession, d: str) -> DataFrame:
    c = V.candidates(spark, d)
    texts = c.groupBy("golden_url", "tool").agg(F.array_sort(F.collect_list(F.struct("candidate_index", "text"))).alias("l")).select("golden_url", "tool", F.transform("l", lambda x: x["text"]).alias("texts"))
    damaged = c.where("not (golden_url = 'case-1' and candidate_index = 0)").withColumn("text", F.when(F.col("golden_url") == "case-2", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    groups = export.singleton_groups(c).where("not (golden_url = 'case-4' and candidate_index = 1)")
    return export.bundle_violations(texts, damaged.select("golden_url", "tool", "candidate_index", "text"), groups)


def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.export_counts(V.candidates(spark, d))


def context_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.context import distinct_contexts

    docs = V.table(spark, d, "documents")
    out = distinct_contexts(docs.select(F.col("source").alias("review_id"), F.col("doc_id").alias("seq"), F.col("text").alias("context"), F.array(F.concat(F.lit("f"), F.col("doc_id") % 5)).alias("files")))
    return out.select("review_id", "context_sha256", "seq", F.array_join("files", ",").alias("files"))


def finding_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import keep_first

    docs = V.table(spark, d, "documents").select("doc_id", F.sha2(norm_space(F.lower("text")), 256).alias("fingerprint"))
    return keep_first(docs, ["fingerprint"], "doc_id").select("doc_id", "fingerprint", "is_first")


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A scorer of the caller's: lengths decide, and some pairs are errors."""

    def scorer(df):
        n = df.comment.str.len() + df.text.str.len()
        return df.assign(match=n % 3 == 0, confidence=(n % 10) / 10, error=n.map(lambda x: "odd" if x % 11 == 0 else None))

    out = judge.score_pairs(judge.pairs(V.golden(spark, d, whole=True), V.candidates(spark, d, whole=True)), scorer)
    return out.groupBy("golden_url", "tool").agg(F.count("*").alias("pairs"), F.count_if("match").alias("matches"), F.count("error").alias("errors"), F.round(F.sum("confidence"), 6).alias("confidence"))


def nested_bundle(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import nested_json

    n = V.candidates(spark, d).groupBy("golden_url", "tool").agg(F.count("*").alias("n"))
    return nested_json(n, "n")


def fixture_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose (review_url, fixture_tool) is not among the case's."""
    o = V.table(spark, d, "orders")
    used = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("fixture_tool")).distinct()
    known = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("fixture_tool"))
    return used.join(known, ["case_id", "fixture_tool"], "left_anti")


def finding_order(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import ordered

    rows = V.findings(spark, d).withColumn("finding_id", F.concat(F.lit("f"), F.col("seq") % 1000)).withColumn("title", F.col("seq").cast("string"))
    return ordered(rows).select("review_id", "seq", F.col("place").cast("long").alias("place"))


RATES = """CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) ELSE 0.0 END AS f1"""
SUMS = "SELECT {keys}CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(texts - matched) AS DOUBLE) AS fp, CAST(sum(comments - tp) AS DOUBLE) AS fn, count(*) AS reviews FROM ev WHERE total_golden > 0 GROUP BY {by}"
SHOWN = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(0 AS BIGINT) AS errors, reviews, " + RATES

METRICS = f"SELECT tool, {SHOWN} FROM ({SUMS.format(keys='tool, ', by='tool')})"

QUERIES = {
    f.__name__: f
    for f in (judge_metrics, judge_evaluations, judge_rollup, judge_running_best, judge_siblings, paired_deltas, judge_resume, judge_queue, candidate_fallback, bundle_replace, bundle_verify, export_counts, context_dedup, finding_dedup, scored_pairs, nested_bundle, fixture_provenance, finding_order)
}
ORACLE = {
    "judge_metrics": f"WITH {V.V6_WHOLE} {METRICS}",
    "judge_evaluations": f"""WITH {V.V6_WHOLE} SELECT golden_url, tool, total_golden = 0 AS skipped, tp, CASE WHEN total_golden > 0 THEN texts - matched ELSE 0 END AS fp, comments - tp AS fn, CAST(0 AS BIGINT) AS errors_count,
      total_candidates, total_golden, round(tp / CAST(total_candidates AS DOUBLE), 9) AS precision, CASE WHEN total_golden > 0 THEN round(tp / CAST(total_golden AS DOUBLE), 9) ELSE 0.0 END AS recall FROM ev""",
    "judge_rollup": f"WITH {V.V6_WHOLE} SELECT coalesce(tool, 'all') AS tool, coalesce(golden_url, 'all') AS golden_url, {SHOWN} FROM ({SUMS.format(keys='tool, golden_url, ', by='ROLLUP (tool, golden_url)')})",
    "judge_running_best": f"WITH {V.V6_WHOLE} SELECT golden_url, tool, golden_index, candidate_index, pair_seq, round(confidence, 9) AS confidence FROM b WHERE improves",
    "judge_siblings": f"""WITH {V.V6}, m AS (SELECT DISTINCT golden_url, tool, candidate_index // 3 AS gi, text FROM c), l AS (SELECT golden_url, tool, text, max(gi) AS gi FROM m GROUP BY ALL)
      SELECT golden_url, tool, count(*) AS links, count(DISTINCT l.text) AS texts FROM l JOIN m USING (golden_url, tool, gi) WHERE l.text <> m.text GROUP BY ALL""",
    "paired_deltas": f"""WITH {V.V6_WHOLE}, r AS (SELECT golden_url, tool, CAST(tp AS DOUBLE) / total_golden AS recall FROM ev WHERE total_golden > 0),
      d AS (SELECT y.recall - x.recall AS d FROM r x JOIN r y USING (golden_url) WHERE x.tool = 'user' AND y.tool = 'assistant')
      SELECT count(*) AS cases, round(avg(d), 9) AS mean_delta, round(stddev_samp(d), 9) AS sd_delta, count(*) FILTER (WHERE d > 0) AS better, count(*) FILTER (WHERE d < 0) AS worse FROM d""",
    "judge_resume": f"WITH {V.V6_WHOLE} SELECT golden_url, tool FROM ev WHERE tool = 'user' OR (CASE WHEN total_golden > 0 THEN texts - matched ELSE 0 END) % 2 <> 0",
    "judge_queue": f"WITH {V.V6} SELECT golden_url, tool, total_golden * total_candidates AS n_pairs FROM ev",
    "candidate_fallback": f"""WITH {V.V6} SELECT golden_url, tool, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM c
      WHERE CAST(golden_url[6:] AS INT) % 2 = 0 OR (tool <> 'user' AND length(text) > 400) GROUP BY ALL""",
    "bundle_replace": f"""WITH {V.V6}, o AS (SELECT golden_url, tool, candidate_index, sha256(text) AS t FROM c),
      cur AS (SELECT * FROM o WHERE golden_url <> 'case-3' AND tool <> 'user'
              UNION ALL SELECT golden_url, tool, candidate_index, sha256(t) FROM o WHERE tool = 'user' AND candidate_index % 2 = 0 AND golden_url <> 'case-5')
      SELECT golden_url, tool, candidate_index, t AS text_sha256 FROM cur
      UNION ALL SELECT golden_url, tool, candidate_index, t FROM o WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.golden_url = o.golden_url AND cur.tool = o.tool)""",
    "bundle_verify": f"""WITH {V.V6}, k AS (SELECT golden_url, tool, count(*) AS n FROM c GROUP BY ALL)
      SELECT golden_url, tool, CASE WHEN golden_url = 'case-1' AND n = 1 THEN 'no candidates' WHEN golden_url IN ('case-1', 'case-2') THEN 'texts differ' ELSE 'groups differ' END AS reason
      FROM k WHERE golden_url IN ('case-1', 'case-2') OR (golden_url = 'case-4' AND n > 1)""",
    "scored_pairs": f"""WITH {V.V6_WHOLE}, x AS (SELECT golden_url, tool, length(comment) + length(text) AS n FROM p)
      SELECT golden_url, tool, count(*) AS pairs, count(*) FILTER (WHERE n % 3 = 0) AS matches, count(*) FILTER (WHERE n % 11 = 0) AS errors, round(sum((n % 10) / CAST(10 AS DOUBLE)), 6) AS confidence FROM x GROUP BY ALL""",
    "nested_bundle": f"""WITH {V.V6} SELECT golden_url, '{{' || string_agg('"' || tool || '":' || n_candidates, ',' ORDER BY tool) || '}}' AS json FROM n GROUP BY golden_url""",
    "fixture_provenance": """SELECT DISTINCT o_custkey AS case_id, o_orderpriority AS fixture_tool FROM orders a WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderkey % 3 <> 0)""",
    "finding_order": f"WITH {V.V5} SELECT review_id, seq, row_number() OVER (PARTITION BY review_id ORDER BY path, line, end_line, 'f' || (seq % 1000), seq::VARCHAR) - 1 AS place FROM findings",
    "export_counts": f"WITH {V.V6} SELECT tool, count(DISTINCT golden_url) AS reviews, count(*) AS candidates FROM c GROUP BY tool",
    "context_dedup": """SELECT source AS review_id, sha256(text) AS context_sha256, min(doc_id) AS seq, string_agg(DISTINCT 'f' || (doc_id % 5), ',' ORDER BY 'f' || (doc_id % 5)) AS files FROM documents GROUP BY source, sha256(text)""",
    "finding_dedup": r"""SELECT doc_id, fp AS fingerprint, row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1 AS is_first
      FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))) AS fp FROM documents)""",
}
