"""Repository text and context: symbols, hits, requests, windows, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, repo
from . import views as V


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return V.src_lines(spark, d).select("commit_sha", "path", "line_no", "text")


def symbol_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    rows = docs.select(F.col("source").alias("review_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("def "), F.coalesce("text", F.lit("")), F.lit(" class Made_"), "doc_id", F.lit(" run_it(1) ")).alias("added"), F.lit("function outer_one() {}").alias("excerpt"))
    return context.rank_symbols(rows, 6).select("review_id", "chunk_id", "symbol", "score", "rank")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """The first word of three letters or more of each benchmark item, asked for in the commits of three sources."""
    word = F.regexp_extract("text", r"([A-Za-z_$][A-Za-z0-9_$]{2,})", 1)
    items = V.table(spark, d, "benchmark").select("item_id", word.alias("symbol")).where("symbol <> ''")
    return items.select(F.col("item_id").cast("string").alias("chunk_id"), F.concat(F.lit("src"), F.col("item_id") % 3).alias("commit_sha"), "symbol")


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    hits = repo.symbol_search(repo.token_index(_lines(spark, d)), _symbols(spark, d))
    return hits.select("chunk_id", "symbol", "path", F.col("line_no").cast("long").alias("line_no"), F.col("rank").cast("long").alias("rank"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Lines made to be of each kind, by document and line."""
    k = F.col("line_no") % 5
    text = F.when(k == 0, F.concat(F.lit("import "), "symbol")).when(k == 1, F.concat(F.lit("def "), "symbol", F.lit("(x):"))).when(k == 2, F.concat(F.lit("  y = "), "symbol", F.lit(" (1)"))).when(k == 3, F.concat(F.lit("z + "), "symbol")).otherwise(F.concat("symbol", F.lit("Other()")))
    path = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))
    return V.src_lines(spark, d).select(F.col("commit_sha").alias("review_id"), F.lit("f$oo").alias("symbol"), "doc_id", path.alias("path"), "line_no").withColumn("text", text)


def hit_kinds(spark: SparkSession, d: str) -> DataFrame:
    return context.classify_hits(_hits(spark, d)).groupBy("review_id", "kind").agg(F.count("*").alias("n"))


def hit_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = context.interleave_hits(context.classify_hits(_hits(spark, d)), ["review_id"], ["path", "line_no"], cap=8)
    return rows.select("review_id", "kind", "path", F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"))


def hit_render(spark: SparkSession, d: str) -> DataFrame:
    rows = context.interleave_hits(context.classify_hits(_hits(spark, d)), ["review_id"], ["path", "line_no"], cap=8)
    return context.render_hits(rows, ["review_id"], 600).groupBy("review_id").agg(F.count_if("kept").alias("kept"), F.sum(F.when(F.col("kept"), F.col("row_chars")).otherwise(0)).cast("long").alias("chars"))


def local_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).select(F.col("review_id").alias("commit_sha"), "path", "line_no", "text")
    return context.local_imports(rows, 2).select("commit_sha", "path", F.col("line_no").cast("long").alias("line_no"))


def _search_requests(spark: SparkSession, d: str) -> DataFrame:
    w = F.element_at(F.split(F.regexp_replace("text", r"^\W+", ""), " "), 2)
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.concat(F.lit("src"), F.col("item_id") % 4).alias("commit_sha"), F.when(F.col("item_id") % 2 == 0, "src/en").otherwise("").alias("prefix"), w.alias("query"), F.when(F.col("item_id") % 3 == 0, 2).cast("int").alias("start"))


def literal_search_page(spark: SparkSession, d: str) -> DataFrame:
    out = repo.literal_search(_search_requests(spark, d).where("query <> ''"), _lines(spark, d), page=5)
    return out.select("request_id", "path", F.col("line_no").cast("long").alias("line_no"), F.col("hit_no").cast("long").alias("hit_no"), "more")


def literal_search_short(spark: SparkSession, d: str) -> DataFrame:
    """Queries of one to fifty characters out of each item, from any place of it."""
    i = F.col("item_id")
    q = F.substring(F.col("text"), (i * 7 % 40 + 1).cast("int"), F.when(i % 3 == 0, i % 3 + 1).when(i % 3 == 1, 2).otherwise(i % 50 + 1).cast("int"))
    req = V.table(spark, d, "benchmark").select(i.alias("request_id"), F.concat(F.lit("src"), i % 4).alias("commit_sha"), F.when(i % 5 == 0, "src/fr").otherwise("").alias("prefix"), q.alias("query"), F.when(i % 4 == 0, 3).cast("int").alias("start"))
    out = repo.literal_search(req.where("query <> '' and not contains(query, '\n')"), _lines(spark, d), page=4)
    return out.select("request_id", "path", F.col("line_no").cast("long").alias("line_no"), F.col("hit_no").cast("long").alias("hit_no"), "more")


def path_list_page(spark: SparkSession, d: str) -> DataFrame:
    req = V.table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.concat(F.lit("src"), F.col("item_id") % 4).alias("commit_sha"), F.when(F.col("item_id") % 2 == 0, "src/en").otherwise("src").alias("prefix"), F.when(F.col("item_id") % 3 == 0, "src/en/5").alias("cursor"))
    out = repo.path_list(req, V.src_files(spark, d), page=7)
    return out.select("request_id", "path", F.col("place").cast("long").alias("place"), "more", F.coalesce("next_cursor", F.lit("")).alias("next_cursor"))


def line_range_read(spark: SparkSession, d: str) -> DataFrame:
    req = V.src_files(spark, d).select(F.col("doc_id").alias("request_id"), "commit_sha", "path", (F.col("doc_id") % 5 + 1).alias("start"), (F.col("doc_id") % 5 + 4).alias("end"))
    return repo.line_range_read(req, _lines(spark, d)).groupBy("request_id").agg(F.count("*").alias("lines"), F.max("line_no").cast("long").alias("last"), F.sum(F.length("text")).alias("chars"))


def request_checks(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    k = F.col("event_id") % 7
    rows = e.select(
        F.col("user_id").alias("review_id"), F.lit("b").alias("batch_id"), (F.col("event_id") % 2).alias("round"), F.col("event_id").alias("seq"),
        F.when(k < 2, "read").when(k < 4, "search").when(k < 6, "list").otherwise("fly").alias("action"), F.when(F.col("event_id") % 11 == 0, "../x").when(F.col("event_id") % 5 == 0, "").otherwise("src/a").alias("path"),
        F.when(k.between(2, 3), "needle").otherwise("").alias("query"), F.when(k == 0, 10).when(k == 1, 20).when(k == 2, 1).cast("int").alias("start_line"), F.when(k == 0, 12).when(k == 1, 5).cast("int").alias("end_line"),
    )
    return repo.validate_requests(rows, cap=30).groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("review_id"), F.lit("b").alias("batch_id"), F.when(F.col("event_id") % 2 == 0, "search").otherwise("list").alias("action"), F.col("event_type").alias("path"), F.lit("q").alias("query"),
        F.when(F.col("event_id") % 4 == 0, 1).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), (F.col("event_id") % 3).alias("round"), F.col("event_id").alias("seq"),
    )


def request_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repo.dedup_requests(_requests(spark, d)).select("seq", "is_first")


def legal_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests; every third also offers a cursor to what has its key, one in four of them none."""
    rows = _requests(spark, d).select("review_id", "batch_id", "action", "path", "query", F.when(F.col("seq") % 5 != 0, F.concat(F.lit("c"), F.col("seq") % 2)).alias("cursor"), "round", "seq")
    offers = rows.where("seq % 3 = 1").withColumn("cursor", F.when(F.col("seq") % 4 != 0, F.concat(F.lit("c"), F.col("seq") % 3))).select("review_id", "batch_id", "action", "path", "query", "cursor", "round")
    return repo.legal_cursors(rows, offers).select("seq", "legal")


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]{3,})", 1))
    rows = docs.select("doc_id", F.col("source").alias("commit_sha"), F.when(word == "", "none").otherwise(word).alias("w"))
    tree = rows.select("commit_sha", F.concat(F.lit("tests/test_"), "w", F.lit("_"), "doc_id", F.lit(".py")).alias("path"))
    want = rows.select(F.col("doc_id").alias("review_id"), "commit_sha", F.concat(F.lit("src/"), "w", F.lit("_mod.py")).alias("path"))
    return repo.related_tests(want, tree, limit=3).select("review_id", "test_path", F.col("rank").cast("long").alias("rank"))


def focus_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ledger(spark, d).where("line is not null").select("review_id", "path", "line", F.lit(1900).alias("n_lines"))
    return context.focus_windows(rows, ["review_id", "path"], 6).select("review_id", "path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def index_prefix(spark: SparkSession, d: str) -> DataFrame:
    return repo.index_prefix(V.src_files(spark, d), 400)


def exposed_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    p = F.concat("lang", F.lit("/"), "doc_id", F.lit(".py"))
    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("my "), p)).otherwise(p)
    k = F.col("doc_id") % 8
    packet = F.concat(F.lit("### CONTEXT 1\nPath: "), p, F.lit("\nwhy\nSURROUNDING SOURCE:\n   7 | y"))
    hidden = F.concat(F.lit("Path: "), p, F.lit("\n### CONTEXT 2\nSURROUNDING SOURCE:\n   7 | y"))
    body = F.when(k == 5, packet).when(k == 6, hidden).when(k == 7, F.concat(F.lit("UNTRUSTED IMMUTABLE HEAD FILE "), p, F.lit(" L1-9\n 1 | z"))).when(k == 0, F.concat(F.lit("### RIGHT source: "), p, F.lit(":1-9\n    1 | x"))).when(k == 1, F.concat(F.lit("### LEFT source: "), p, F.lit(":1-9\nno rows\n### next"))).when(k == 2, F.concat(F.lit("- USAGE f — "), p, F.lit(":3: x"))).when(k == 3, F.concat(F.lit("see "), p)).otherwise(F.concat(p, F.lit(":12: hit")))
    return context.exposed_paths(docs.select(F.col("source").alias("review_id"), body.alias("context")))


def capacity(spark: SparkSession, d: str) -> DataFrame:
    rows = V.items(spark, d).select("conv_id", "turn", F.col("n").alias("budget"))
    out = context.search_capacity(rows)
    return out.select("conv_id", "turn", *[F.col(c).cast("long").alias(c) for c in ("evidence_budget", "evidence_rows", "searchable_symbols", "hits_per_symbol")])


def final_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = V.items(spark, d).withColumn("seed", F.coalesce(F.lag("text").over(w), F.lit("")))
    return rows.select("conv_id", "turn", F.sha2(T.assemble_context(F.col("text"), F.col("seed"), 900), 256).alias("context_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        literal_search_short, symbol_rank, symbol_search, hit_kinds, hit_interleave, hit_render, local_imports, literal_search_page, path_list_page, line_range_read, request_checks, request_dedup, legal_cursors, related_tests, focus_windows, index_prefix,
        exposed_paths, capacity, final_context,
    )
}
_KW = ", ".join(f"'{w}'" for w in context.KEYWORDS)
HITS = f"""{V.V1}, h AS (
  SELECT commit_sha AS review_id, CASE WHEN doc_id % 6 = 0 THEN 'tests/' || path ELSE path END AS path, line_no, doc_id, CASE line_no % 5 WHEN 0 THEN 'import f$oo' WHEN 1 THEN 'def f$oo(x):' WHEN 2 THEN 'y = f$oo (1)' WHEN 3 THEN 'z + f$oo' ELSE 'f$ooOther()' END AS snippet,
         CASE WHEN doc_id % 6 = 0 THEN 'test' ELSE CASE line_no % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'definition' WHEN 2 THEN 'caller' ELSE 'usage' END END AS kind
  FROM v1),
il AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY CASE WHEN t <= 3 THEN 0 ELSE t END, nth, t) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id, kind ORDER BY path, line_no) AS nth, CASE kind WHEN 'definition' THEN 1 WHEN 'caller' THEN 2 WHEN 'test' THEN 3 WHEN 'import' THEN 4 ELSE 5 END AS t FROM h) WHERE nth <= 8)"""
ORACLE = {
    "symbol_rank": f"""WITH s AS (SELECT source AS review_id, doc_id AS chunk_id, 'def ' || coalesce(text, '') || ' class Made_' || doc_id || ' run_it(1) ' AS a FROM documents),
      p AS (SELECT review_id, chunk_id, 0 AS pass, regexp_extract_all(a, '\\b(?:async\\s+)?(?:def|function|fn|func|class|interface|trait|struct|enum|type)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS l FROM s
        UNION ALL SELECT review_id, chunk_id, 1, regexp_extract_all(a, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\s*(?:<[^\\n;()]*>)?\\s*\\(', 1) FROM s
        UNION ALL SELECT review_id, chunk_id, 2, regexp_extract_all(a, '[A-Za-z_$][A-Za-z0-9_$]*') FROM s UNION ALL SELECT review_id, chunk_id, 3, ['outer_one'] FROM s),
      r AS (SELECT review_id, chunk_id, pass, unnest(l) AS symbol, generate_subscripts(l, 1) AS nth FROM p),
      b AS (SELECT review_id, chunk_id, symbol, max(CASE WHEN pass IN (0, 3) THEN 5 WHEN pass = 1 THEN 4 WHEN regexp_matches(symbol, '^[A-Z]|_') THEN 3 ELSE 1 END) AS score, min(pass * 1000000 + nth) AS f FROM r WHERE length(symbol) BETWEEN 3 AND 80 AND lower(symbol) NOT IN ({_KW}) GROUP BY ALL)
      SELECT review_id, chunk_id, symbol, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY review_id, chunk_id ORDER BY score DESC, f, symbol) AS rank FROM b) WHERE rank <= 6""",
    "symbol_search": f"""WITH {V.V1}, q AS (SELECT item_id::VARCHAR AS chunk_id, 'src' || (item_id % 3) AS commit_sha, regexp_extract(text, '([A-Za-z_$][A-Za-z0-9_$]{{2,}})', 1) AS symbol FROM benchmark),
      t AS (SELECT DISTINCT commit_sha, path, line_no, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS symbol FROM v1)
      SELECT chunk_id, symbol, path, line_no, rank FROM (SELECT chunk_id, symbol, path, line_no, row_number() OVER (PARTITION BY chunk_id ORDER BY path, line_no) AS rank FROM q JOIN t USING (commit_sha, symbol) WHERE symbol <> '') WHERE rank <= 10""",
    "hit_kinds": f"WITH {HITS} SELECT review_id, kind, count(*) AS n FROM h GROUP BY ALL",
    "hit_interleave": f"WITH {HITS} SELECT review_id, kind, path, line_no, place FROM il",
    "hit_render": f"""WITH RECURSIVE {HITS}, w AS (SELECT review_id, place AS k, least(96, length(chr(10) || '- ' || CASE kind WHEN 'definition' THEN 'DEFINITION' WHEN 'caller' THEN 'CALL SITE' WHEN 'test' THEN 'TEST HINT' WHEN 'import' THEN 'IMPORT' ELSE 'USAGE' END || ' f$oo — ' || path || ':' || line_no || ': ' || snippet)) AS n FROM il),
      f(review_id, k, used, kept, n) AS (SELECT review_id, k, CASE WHEN n <= 600 THEN n ELSE 0 END, n <= 600, n FROM w WHERE k = 1
        UNION ALL SELECT w.review_id, w.k, CASE WHEN f.used + w.n <= 600 THEN f.used + w.n ELSE f.used END, f.used + w.n <= 600, w.n FROM f JOIN w ON w.review_id = f.review_id AND w.k = f.k + 1)
      SELECT review_id, count(*) FILTER (WHERE kept) AS kept, CAST(coalesce(sum(n) FILTER (WHERE kept), 0) AS BIGINT) AS chars FROM f GROUP BY review_id""",
    "local_imports": f"WITH {HITS} SELECT review_id AS commit_sha, path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY review_id, path ORDER BY line_no) AS r FROM h WHERE line_no % 5 = 0) WHERE r <= 2",
    "literal_search_page": f"""WITH {V.V1}, q AS (SELECT item_id AS request_id, 'src' || (item_id % 4) AS commit_sha, CASE WHEN item_id % 2 = 0 THEN 'src/en' ELSE '' END AS prefix, string_split(regexp_replace(text, '^[^A-Za-z0-9_]+', ''), ' ')[2] AS query, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS start FROM benchmark),
      m AS (SELECT request_id, path, line_no, start, row_number() OVER (PARTITION BY request_id ORDER BY path, line_no) AS hit_no, count(*) OVER (PARTITION BY request_id) AS total FROM q JOIN v1 USING (commit_sha) WHERE query <> '' AND contains(text, query) AND (prefix = '' OR path = prefix OR starts_with(path, prefix || '/')))
      SELECT request_id, path, line_no, hit_no, total >= start + 5 AS more FROM m WHERE hit_no BETWEEN start AND start + 4""",
    "literal_search_short": f"""WITH {V.V1}, q AS (SELECT item_id AS request_id, 'src' || (item_id % 4) AS commit_sha, CASE WHEN item_id % 5 = 0 THEN 'src/fr' ELSE '' END AS prefix, substr(text, item_id * 7 % 40 + 1, CASE item_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE item_id % 50 + 1 END) AS query, CASE WHEN item_id % 4 = 0 THEN 3 ELSE 1 END AS start FROM benchmark),
      m AS (SELECT request_id, path, line_no, start, row_number() OVER (PARTITION BY request_id ORDER BY path, line_no) AS hit_no, count(*) OVER (PARTITION BY request_id) AS total FROM q JOIN v1 USING (commit_sha) WHERE query <> '' AND NOT contains(query, chr(10)) AND contains(text, query) AND (prefix = '' OR path = prefix OR starts_with(path, prefix || '/')))
      SELECT request_id, path, line_no, hit_no, total >= start + 4 AS more FROM m WHERE hit_no BETWEEN start AND start + 3""",
    "path_list_page": """WITH t AS (SELECT DISTINCT source AS commit_sha, 'src/' || lang || '/' || doc_id || '.txt' AS path FROM documents),
      q AS (SELECT item_id AS request_id, 'src' || (item_id % 4) AS commit_sha, CASE WHEN item_id % 2 = 0 THEN 'src/en' ELSE 'src' END AS prefix, CASE WHEN item_id % 3 = 0 THEN 'src/en/5' ELSE '' END AS cur FROM benchmark),
      m AS (SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY path) AS place, count(*) OVER (PARTITION BY request_id) AS total FROM q JOIN t USING (commit_sha) WHERE starts_with(path, prefix || '/') AND path > cur)
      SELECT request_id, path, place, total > 7 AS more, CASE WHEN total > 7 THEN max(path) OVER (PARTITION BY request_id) ELSE '' END AS next_cursor FROM m WHERE place <= 7""",
    "line_range_read": f"WITH {V.V1} SELECT doc_id AS request_id, count(*) AS lines, max(line_no) AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM v1 WHERE line_no BETWEEN doc_id % 5 + 1 AND doc_id % 5 + 4 GROUP BY doc_id",
    "request_checks": """WITH e AS (SELECT *, event_id % 7 AS k, event_id % 11 = 0 AS bad, event_id % 11 <> 0 AND event_id % 5 = 0 AS empty, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS r FROM events)
      SELECT CASE WHEN r > 30 THEN 'too many requests' WHEN k = 6 THEN 'action type is unsupported' WHEN k < 2 AND (bad OR empty OR k = 1) THEN 'read action has invalid arguments' WHEN k IN (2, 3) AND bad THEN 'search action has invalid arguments'
        WHEN k IN (4, 5) AND bad THEN 'list action has invalid arguments' ELSE '' END AS error, count(*) AS n FROM e GROUP BY 1""",
    "request_dedup": "SELECT event_id AS seq, row_number() OVER (PARTITION BY user_id, event_id % 2, event_type, CASE WHEN event_id % 2 = 1 THEN 0 ELSE 1 END ORDER BY event_id % 3, event_id) = 1 AS is_first FROM events",
    "legal_cursors": """WITH r AS (SELECT event_id AS seq, user_id, event_id % 2 AS a, event_type AS p, CASE WHEN event_id % 5 <> 0 THEN 'c' || (event_id % 2) END AS cur, event_id % 3 AS round FROM events),
      o AS (SELECT user_id, a, p, round, max(CASE WHEN seq % 4 <> 0 THEN 'c' || (seq % 3) END) AS cur FROM r WHERE seq % 3 = 1 GROUP BY ALL),
      l AS (SELECT r.seq, r.cur, max(o.round) AS last FROM r LEFT JOIN o ON o.user_id = r.user_id AND o.a = r.a AND o.p = r.p AND o.round < r.round GROUP BY r.seq, r.cur)
      SELECT l.seq, CASE WHEN l.last IS NULL THEN l.cur IS NULL ELSE coalesce(o.cur = l.cur, false) END AS legal FROM l JOIN r USING (seq) LEFT JOIN o ON o.user_id = r.user_id AND o.a = r.a AND o.p = r.p AND o.round = l.last""",
    "related_tests": """WITH w AS (SELECT doc_id, source, CASE WHEN x = '' THEN 'none' ELSE lower(x) END AS w FROM (SELECT doc_id, source, regexp_extract(text, '([A-Za-z]{3,})', 1) AS x FROM documents)),
      t AS (SELECT w, source, doc_id, 'tests/test_' || w || '_' || doc_id || '.py' AS test_path, 'test_' || w || '_' || doc_id AS stem FROM w),
      m AS (SELECT DISTINCT a.doc_id AS review_id, test_path FROM w a JOIN t ON a.source = t.source AND (a.w = t.w OR contains(stem, a.w || '_mod') OR (length(t.doc_id::VARCHAR) >= 3 AND a.w = t.doc_id::VARCHAR) OR a.w = 'test' OR t.w = 'mod'))
      SELECT review_id, test_path, rank FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY test_path) AS rank FROM m) WHERE rank <= 3""",
    "focus_windows": f"""WITH {V.V5}, f AS (SELECT DISTINCT review_id, path, greatest(1, least(line, 1900)) AS x FROM ledger WHERE line IS NOT NULL), w AS (SELECT DISTINCT review_id, path, greatest(1, x - 6) AS s, least(1900, x + 6) AS e FROM f),
      m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY review_id, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS nw FROM w),
      i AS (SELECT *, sum(nw) OVER (PARTITION BY review_id, path ORDER BY s, e) AS g FROM m) SELECT review_id, path, min(s) AS start, max(e) AS "end" FROM i GROUP BY review_id, path, g""",
    "index_prefix": """WITH t AS (SELECT DISTINCT source AS commit_sha, 'src/' || lang || '/' || doc_id || '.txt' AS path FROM documents), u AS (SELECT *, sum(length(path) + 1) OVER (PARTITION BY commit_sha ORDER BY path) - 1 AS used, sum(length(path) + 1) OVER (PARTITION BY commit_sha) - 1 AS whole FROM t),
      g AS (SELECT commit_sha, coalesce(string_agg(path, chr(10) ORDER BY path) FILTER (WHERE whole <= 400 OR used + 61 <= 400), '') AS p, max(whole) > 400 AS truncated FROM u GROUP BY commit_sha)
      SELECT commit_sha, CASE WHEN truncated THEN left(p || CASE WHEN p <> '' THEN chr(10) ELSE '' END || '...[repository index truncated; use list to inspect a prefix]', 400) ELSE p END AS index, truncated FROM g""",
    "exposed_paths": "SELECT DISTINCT source AS review_id, CASE WHEN doc_id % 3 = 0 THEN 'my ' ELSE '' END || lang || '/' || doc_id || '.py' AS path FROM documents WHERE doc_id % 8 IN (0, 2, 4, 5, 7)",
    # from the documented shares: a quarter (120 at least), a fifth (64) and a quarter (64) off, and 40
    "capacity": """WITH b AS (SELECT conv_id, turn, length(text) AS b FROM conversations), e AS (SELECT *, greatest(0, b - greatest(120, b // 4) - greatest(64, b // 5) - greatest(64, b // 4) - 40) AS e FROM b),
      s AS (SELECT *, e // 96 AS r, least(24, CASE WHEN e >= 96 THEN (e + 199) // 200 ELSE 0 END) AS y FROM e)
      SELECT conv_id, turn, CAST(e AS BIGINT) AS evidence_budget, CAST(r AS BIGINT) AS evidence_rows, CAST(y AS BIGINT) AS searchable_symbols, CAST(CASE WHEN y > 0 THEN least(10, greatest(3, (r + y - 1) // y)) ELSE 0 END AS BIGINT) AS hits_per_symbol FROM s""",
    "final_context": """WITH x AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS seed, chr(10) || '...[context truncated at 900 characters]' AS m FROM conversations),
      y AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN text <> '' THEN text END, CASE WHEN seed <> '' THEN seed END) AS c FROM x) SELECT conv_id, turn, sha256(CASE WHEN length(c) <= 900 THEN c ELSE left(c, 900 - length(m)) || m END) AS context_sha256 FROM y""",
}
