"""The driver's tables as inputs of the operators: each view in Spark and, as a WITH clause, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_splitlines
from ..operators import judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# V1: documents as source files of a commit for each source.
def src_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select(F.col("source").alias("commit_sha"), path.alias("path"), "doc_id", F.col("text").alias("content"))


def src_lines(spark: SparkSession, d: str) -> DataFrame:
    return src_files(spark, d).select("commit_sha", "path", "doc_id", F.posexplode(py_splitlines(F.col("content"))).alias("i", "text")).select("commit_sha", "path", "doc_id", (F.col("i") + 1).alias("line_no"), "text")


V1 = r"""
v1 AS (
  SELECT source AS commit_sha, 'src/' || lang || '/' || doc_id || '.txt' AS path, doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS line_no
  FROM (SELECT *, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''))"""

# V2: a patch for each document, of one hunk; lines go, stay or come by their number, and paths by doc_id.
PATHS = ("vendor/x/{}.js", "dist/{}.js", "pkg/{}.lock", "src/{}.generated.ts", "src/{}_pb2.py", "src/{}.ts", "tests/{}_test.py", "node_modules/{}.js", "lib/{}.min.js")


def diffs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''")
    path = F.element_at(F.array(*[F.regexp_replace(F.lit(p), r"\{\}", F.col("doc_id").cast("string")) for p in PATHS]), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    mark = lambda x, i: F.concat(F.when((i + 1) % 5 == 0, "-").when((i + 1) % 5 == 1, " ").otherwise("+"), x)
    rows = docs.select(F.col("doc_id").cast("string").alias("review_id"), path.alias("p"), py_splitlines(F.col("text")).alias("l"))
    n = F.size("l")
    deleted, kept = F.floor(n / 5), F.floor((n + 4) / 5)
    head = F.concat(F.lit("diff --git a/"), "p", F.lit(" b/"), "p", F.lit("\n--- a/"), "p", F.lit("\n+++ b/"), "p", F.lit("\n@@ -1,"), (deleted + kept).cast("string"), F.lit(" +1,"), (n - deleted).cast("string"), F.lit(" @@ body\n"))
    return rows.select("review_id", F.concat(head, F.array_join(F.transform("l", mark), "\n"), F.lit("\n")).alias("raw"))


_CASES = " ".join(f"WHEN {i} THEN '{p.split('{}')[0]}' || doc_id || '{p.split('{}')[1]}'" for i, p in enumerate(PATHS))
V2 = (
    V1
    + f""",
dl AS (
  SELECT doc_id::VARCHAR AS review_id, CASE doc_id % {len(PATHS)} {_CASES} END AS path, line_no, text,
         CASE line_no % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'context' ELSE 'add' END AS kind,
         CASE WHEN line_no % 5 IN (0, 1) THEN (sum((line_no % 5 IN (0, 1))::INT) OVER w)::BIGINT ELSE 0 END AS old_line,
         CASE WHEN line_no % 5 <> 0 THEN (sum((line_no % 5 <> 0)::INT) OVER w)::BIGINT ELSE 0 END AS new_line
  FROM v1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
ex AS (
  SELECT review_id, path, CASE WHEN path LIKE '%.lock' THEN 'lockfile' WHEN path LIKE 'vendor/%' OR path LIKE 'node_modules/%' THEN 'vendor'
         WHEN path LIKE 'dist/%' OR path LIKE '%.generated.ts' OR path LIKE '%_pb2.py' OR path LIKE '%.min.js' THEN 'generated' END AS exclusion_kind
  FROM (SELECT DISTINCT review_id, path FROM dl))"""
)


# V3: calls.
def calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("review_id"), F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"), "ts", F.when(k % 10 != 0, k).alias("input_tokens"),
        F.lit(None).cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("cached_input_tokens"), F.lit(None).cast("double").alias("cost_usd"), F.when(F.col("event_type") == "error", "error").alias("error"),
    )


V3 = """
calls AS (
  SELECT user_id AS review_id, event_type AS stage, value AS latency_ms, ts,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS input_tokens,
         CASE WHEN event_type = 'error' THEN 'error' END AS error
  FROM events)"""


# V4: run records.
def records(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("resumed")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("case_id"), status.alias("status"), F.col("o_orderdate").alias("committed_at"), "o_orderkey")


V4 = """
records AS (
  SELECT o_orderpriority AS model, o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'resumed' END AS status, o_orderdate AS committed_at, o_orderkey
  FROM orders)"""


# V5: a ledger of changed lines, and findings against it.
def _item(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") % 2 == 0, "LEFT").otherwise("RIGHT")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("review_id"), side.alias("side"), F.concat("l_returnflag", "l_linestatus").alias("path"), F.col("l_partkey").alias("line"), "l_orderkey", "l_linenumber", "l_quantity")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return _item(spark, d).where(F.col("l_orderkey") % 2 == 0).select("review_id", "side", "path", "line").distinct()


def findings(spark: SparkSession, d: str) -> DataFrame:
    rows = _item(spark, d).where(F.col("l_orderkey") % 2 == 1)
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return rows.groupBy("review_id", seq.alias("seq")).agg(F.min(F.struct("side", "path", "line", F.col("l_quantity").cast("int").alias("q"))).alias("r")).select("review_id", "seq", "r.side", "r.path", "r.line", (F.col("r.line") + F.col("r.q") % 3).alias("end_line"), F.col("r.q").alias("q"))


V5 = """
item AS (
  SELECT l_suppkey AS review_id, CASE WHEN l_linenumber % 2 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, l_returnflag || l_linestatus AS path, l_partkey AS line,
         l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem),
ledger AS (SELECT DISTINCT review_id, side, path, line FROM item WHERE l_orderkey % 2 = 0),
findings AS (
  SELECT review_id, seq, side, path, line, line + q % 3 AS end_line, q
  FROM (SELECT *, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY review_id, l_orderkey * 10 + l_linenumber ORDER BY side, path, line, q) AS rn FROM item WHERE l_orderkey % 2 = 1)
  WHERE rn = 1)"""

# V6: golden issues are benchmark items, candidates the turns of conversations. In V6_WHOLE, eight cases take them by turns, so that every turn meets golden
# issues; in V6 a case is so many that follow one another, and turns past the last item's case meet none.
CASES, CASE_ITEMS, CASE_CONVS, THRESHOLD = 8, 5, 12, 0.06


def golden(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    case = F.col("item_id") % CASES if whole else F.floor(F.col("item_id") / CASE_ITEMS)
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("case-"), case.cast("string")).alias("golden_url"), (F.row_number().over(Window.partitionBy(case).orderBy("item_id")) - 1).alias("golden_index"), F.col("text").alias("comment"))
    return judge.with_words(rows, "comment", "comment_words")


def candidates(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    case = F.col("conv_id") % CASES if whole else F.floor(F.col("conv_id") / CASE_CONVS)
    w = Window.partitionBy(case, "role").orderBy("conv_id", "turn")
    rows = table(spark, d, "conversations").where("text <> ''").select(F.concat(F.lit("case-"), case.cast("string")).alias("golden_url"), F.col("role").alias("tool"), (F.row_number().over(w) - 1).alias("candidate_index"), "text", "conv_id", "turn")
    return judge.with_words(rows, "text", "text_words")


def verdicts(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return judge.score_pairs(judge.pairs(golden(spark, d, whole), candidates(spark, d, whole)), threshold=THRESHOLD)


def _v6(item_case: str, conv_case: str) -> str:
    return f"""
g AS (
  SELECT 'case-' || ({item_case}) AS golden_url, row_number() OVER (PARTITION BY {item_case} ORDER BY item_id) - 1 AS golden_index, text AS comment,
         list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS gw FROM benchmark),
c AS (
  SELECT 'case-' || ({conv_case}) AS golden_url, role AS tool, row_number() OVER (PARTITION BY {conv_case}, role ORDER BY conv_id, turn) - 1 AS candidate_index, text, conv_id, turn,
         list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS cw FROM conversations WHERE text <> ''),
n AS (SELECT golden_url, tool, count(*) AS n_candidates FROM c GROUP BY ALL),
p AS (
  SELECT *, golden_index * n_candidates + candidate_index AS pair_seq, len(list_intersect(gw, cw)) AS shared FROM g JOIN c USING (golden_url) JOIN n USING (golden_url, tool)),
v AS (SELECT *, CASE WHEN len(gw) + len(cw) - shared = 0 THEN 0.0 ELSE CAST(shared AS DOUBLE) / (len(gw) + len(cw) - shared) END AS confidence FROM p),
b AS (
  SELECT *, confidence >= {THRESHOLD} AND confidence > coalesce(max(CASE WHEN confidence >= {THRESHOLD} THEN confidence END) OVER (
           PARTITION BY golden_url, tool, comment ORDER BY pair_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS improves FROM v),
ev AS (
  SELECT golden_url, tool, (SELECT count(DISTINCT comment) FROM b WHERE improves AND b.golden_url = n.golden_url AND b.tool = n.tool) AS tp,
         (SELECT count(DISTINCT text) FROM b WHERE improves AND b.golden_url = n.golden_url AND b.tool = n.tool) AS matched,
         (SELECT count(DISTINCT text) FROM c WHERE c.golden_url = n.golden_url AND c.tool = n.tool) AS texts, n_candidates AS total_candidates,
         (SELECT count(*) FROM g WHERE g.golden_url = n.golden_url) AS total_golden, (SELECT count(DISTINCT comment) FROM g WHERE g.golden_url = n.golden_url) AS comments
  FROM n)"""


V6 = _v6(f"item_id // {CASE_ITEMS}", f"conv_id // {CASE_CONVS}")
V6_WHOLE = _v6(f"item_id % {CASES}", f"conv_id % {CASES}")


# V7: verifier decisions out of labels, in batches of 20.
def decisions(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "keep").otherwise("merge")
    i = F.col("doc_id") % 20
    return table(spark, d, "labels").select(
        (F.col("doc_id") % 7).alias("review_id"), F.floor(F.col("doc_id") / 20).alias("batch_offset"), i.alias("candidate_index"), said.alias("decision"),
        (F.lit(0.7) + (F.col("doc_id") % 30) / 100).alias("confidence"), F.lit("because").alias("reason"), F.when(said == "merge", F.greatest(i - 1, F.lit(0))).alias("canonical_index"),
    )


V7 = """
dec AS (
  SELECT doc_id % 7 AS review_id, CAST(floor(doc_id / 20) AS BIGINT) AS batch_offset, doc_id % 20 AS candidate_index, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'keep' ELSE 'merge' END AS decision,
         0.7::DOUBLE + (doc_id % 30) / 100.0::DOUBLE AS confidence, CASE WHEN toxic = 1 OR quality = 1 THEN NULL ELSE greatest(doc_id % 20 - 1, 0) END AS canonical_index FROM labels)"""


# V8: items to pack are turns of conversations with their length.
def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), "text")


V8 = """
it AS (SELECT conv_id, turn, role, length(text)::BIGINT AS n, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"""
