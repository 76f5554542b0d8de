"""Diffs: lines, files, exclusions, ledgers, chunks, batches, statistics, cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, diffs, packing
from . import views as V


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return diffs.tables(diffs.parsed_once(V.diffs(spark, d)))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    files, _, lines, _ = _tables(spark, d)
    return diffs.classify_files(files, lines)


def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    _, _, lines, _ = _tables(spark, d)
    return lines.select("review_id", "source_id", "kind", F.sha2("content", 256).alias("content_sha256"), F.coalesce(F.col("old_line").cast("long"), F.lit(0)).alias("old_line"), F.coalesce(F.col("new_line").cast("long"), F.lit(0)).alias("new_line"))


def line_annotations(spark: SparkSession, d: str) -> DataFrame:
    _, _, lines, _ = _tables(spark, d)
    return lines.select("review_id", "source_id", diffs.annotate(F.col("kind"), F.col("old_line"), F.col("new_line"), F.col("raw")).alias("annotated"))


def diff_files(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, _, _ = _tables(spark, d)
    return files.join(hunks, ["review_id", "file_index", "path"]).select("review_id", "path", "old_path", "status", "hunk_id", F.col("old_count").cast("long").alias("old_count"), F.col("new_count").cast("long").alias("new_count"))


def file_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("review_id", "path", "exclusion_kind")


def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    per = diffs.exclusion_counts(_classified(spark, d))
    return per.groupBy("exclusion_kind").agg(F.sum("files").alias("files"))


def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, lines, _ = _tables(spark, d)
    return diffs.diff_stats(V.diffs(spark, d), files, hunks, lines).drop("sha256")


def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    files, _, lines, _ = _tables(spark, d)
    ranges = diffs.compact_ranges(diffs.changed_line_ledger(files, lines))
    return ranges.select("review_id", "side", "path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def ledger_ranges(spark: SparkSession, d: str) -> DataFrame:
    return diffs.compact_ranges(V.ledger(spark, d))


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, lines, _ = _tables(spark, d)
    rows, _ = diffs.pack_chunks(diffs.classify_files(files, lines), hunks, lines, 6_000)
    return rows.where("source_id is not null").groupBy("review_id", "chunk_index").agg(F.count("*").alias("lines"), F.min("source_id").alias("first_line"), F.max("source_id").alias("last_line")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunk_errors(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, lines, _ = _tables(spark, d)
    _, errors = diffs.pack_chunks(diffs.classify_files(files, lines), hunks, lines, 600)
    return errors.select("review_id", "error")


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, lines, _ = _tables(spark, d)
    rows, _ = diffs.pack_chunks(diffs.classify_files(files, lines), hunks, lines, 20_000)
    done = diffs.chunks(rows, files, hunks, lines)
    return done.groupBy("review_id").agg(F.sum("char_count").alias("chars"), F.count("*").alias("chunks"), F.max(F.col("char_count") <= 20_000).alias("within"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, lines, _ = _tables(spark, d)
    rows, _ = diffs.pack_chunks(diffs.classify_files(files, lines), hunks, lines, 200_000)
    return rows.groupBy("review_id", "chunk_id", "segment_id").agg(F.count("*").alias("lines"))


def partition_check(spark: SparkSession, d: str) -> DataFrame:
    files, hunks, lines, _ = _tables(spark, d)
    files = diffs.classify_files(files, lines)
    rows, _ = diffs.pack_chunks(files, hunks, lines, 200_000)
    damaged = rows.where("not (source_id like '%:l000003')")
    return diffs.check_partition(files, lines, damaged)


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    it = V.items(spark, d).select(F.col("conv_id").alias("review_id"), F.lit(0).alias("file_index"), F.col("turn").alias("chunk_index"), F.concat(F.lit("c"), "turn").alias("chunk_id"), F.col("n").alias("char_count"))
    out = diffs.pack_batches(it, 2_000)
    return out.select("review_id", F.col("batch_index").cast("long").alias("batch_index"), "batch_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), "patch_chars")


def budget_split(spark: SparkSession, d: str) -> DataFrame:
    it = V.items(spark, d).select("conv_id", "turn", F.concat(F.lit("c"), "turn").alias("chunk_id"), F.col("role").alias("path"))
    return diffs.split_budget(it, 1_000, ["conv_id"], ["turn"]).select("conv_id", "turn", "budget")


def fair_share(spark: SparkSession, d: str) -> DataFrame:
    out = packing.fair_share(V.items(spark, d).select("conv_id", "turn", "n"), ["conv_id"], ["turn"], "n", 1_500)
    return out.select("conv_id", "turn", "allocation")


def skip_fit_render(spark: SparkSession, d: str) -> DataFrame:
    out = packing.render_fitting(V.items(spark, d).select("conv_id", "turn", "n"), ["conv_id"], ["turn"], "n", 1_200)
    return out.select("conv_id", "turn", "kept")


def prefix_fit(spark: SparkSession, d: str) -> DataFrame:
    out = packing.prefix_fit(V.items(spark, d).select("conv_id", "turn", "n"), ["conv_id"], ["turn"], F.col("n") + 1, 1_200)
    return out.select("conv_id", "turn")


def anchor_excerpts(spark: SparkSession, d: str) -> DataFrame:
    lines = V.src_lines(spark, d)
    at = lines.select("commit_sha", "path", F.col("line_no").alias("line"), F.concat_ws(":", "path", "line_no").alias("finding"))
    out = packing.anchor_excerpts(lines.select("commit_sha", "path", "line_no", "text"), at, ["finding"], ["commit_sha", "path"], radius=2)
    return out.select("finding", F.sha2("excerpt", 256).alias("excerpt_sha256"), F.length("excerpt").cast("long").alias("chars"))


def risk_cues(spark: SparkSession, d: str) -> DataFrame:
    docs = V.src_lines(spark, d)
    cue = F.when(F.col("line_no") % 11 == 0, F.when(F.col("doc_id") % 3 == 0, "xs.forEach(async x => f(x))").when(F.col("doc_id") % 3 == 1, "ys.map( async y => g(y))").otherwise("db.query(`select ${id}`)")).otherwise(F.col("text"))
    added = docs.select(F.col("commit_sha").alias("review_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.concat("doc_id", F.when(F.col("doc_id") % 2 == 0, ".ts").otherwise(".py")).alias("path"), F.col("line_no").alias("line_index"), F.col("line_no").alias("new_line"), cue.alias("content"))
    return context.risk_hypotheses(added).select("review_id", "hypothesis_id", "path", F.col("line").cast("long").alias("line"), "cue")


#: Longest annotated line and hunk header of V2; a fold over lines for next-fit packing.
_LENGTHS = (
    V.V2
    + """,
h AS (
  SELECT review_id, path, 3 * 6 + length('diff --git ') + 4 * length(path) AS dummy,
         length('diff --git a/' || path || ' b/' || path) + 1 + length('--- a/' || path) + 1 + length('+++ b/' || path) + 1 AS head,
         length('@@ -1,' || sum((kind <> 'add')::INT) || ' +1,' || sum((kind <> 'delete')::INT) || ' @@ body') + 1 AS hunk_head, count(*) AS n_lines
  FROM dl JOIN (SELECT review_id AS r FROM ex WHERE exclusion_kind IS NULL) ON r = review_id GROUP BY review_id, path),
ln AS (
  SELECT dl.review_id, line_no, h.head, h.hunk_head, greatest(15, length(CASE kind WHEN 'add' THEN 'R' || new_line WHEN 'delete' THEN 'L' || old_line ELSE 'R' || new_line || '/L' || old_line END)) + 3 + 1 + length(text) + 1 AS n
  FROM dl JOIN h USING (review_id)),
bad AS (SELECT DISTINCT review_id FROM ln WHERE head + hunk_head + n > {cap})"""
)


def _next_fit(rows: str, key: str, cap: int, sep: int = 0) -> str:
    """Recursive next-fit over rows (key, k from 1, n, base)."""
    return f"""
    src AS ({rows}),
    fit({key}, k, g, used) AS (
      SELECT {key}, k, 0, base + n FROM src WHERE k = 1
      UNION ALL
      SELECT s.{key}, s.k, CASE WHEN f.used + {sep} + s.n > {cap} THEN f.g + 1 ELSE f.g END, CASE WHEN f.used + {sep} + s.n > {cap} THEN s.base + s.n ELSE f.used + {sep} + s.n END
      FROM fit f JOIN src s ON s.{key} = f.{key} AND s.k = f.k + 1)"""


SRC_ID = "'f0000:h0000:l' || lpad(CAST(line_no - 1 AS VARCHAR), 6, '0')"
QUERIES = {
    f.__name__: f
    for f in (
        diff_lines, line_annotations, diff_files, file_exclusions, exclusion_counts, diff_stats, changed_lines, ledger_ranges, chunk_plan, chunk_errors, chunk_sizes, chunk_ids, partition_check,
        batch_plan, budget_split, fair_share, skip_fit_render, prefix_fit, anchor_excerpts, risk_cues,
    )
}
_ISLANDS = "SELECT review_id, side, path, min(line) AS start, max(line) AS \"end\" FROM (SELECT *, line - row_number() OVER (PARTITION BY review_id, side, path ORDER BY line) AS i FROM {t}) GROUP BY review_id, side, path, i"
ORACLE = {
    "diff_lines": f"WITH {V.V2} SELECT review_id, {SRC_ID} AS source_id, kind, sha256(text) AS content_sha256, old_line, new_line FROM dl",
    "line_annotations": f"""WITH {V.V2}, a AS (SELECT *, CASE kind WHEN 'add' THEN 'R' || new_line WHEN 'delete' THEN 'L' || old_line ELSE 'R' || new_line || '/L' || old_line END AS place FROM dl)
      SELECT review_id, {SRC_ID} AS source_id, lpad(place, CAST(greatest(15, length(place)) AS INT), ' ') || ' | ' || CASE kind WHEN 'add' THEN '+' WHEN 'delete' THEN '-' ELSE ' ' END || text AS annotated FROM a""",
    "diff_files": f"""WITH {V.V2} SELECT review_id, path, path AS old_path, 'modified' AS status, path || ':1:1:h000' AS hunk_id, CAST(sum((kind <> 'add')::INT) AS BIGINT) AS old_count, CAST(sum((kind <> 'delete')::INT) AS BIGINT) AS new_count FROM dl GROUP BY review_id, path""",
    "file_exclusions": f"WITH {V.V2} SELECT review_id, path, exclusion_kind FROM ex",
    "exclusion_counts": f"WITH {V.V2} SELECT exclusion_kind, count(*) AS files FROM ex WHERE exclusion_kind IS NOT NULL GROUP BY exclusion_kind",
    "diff_stats": f"""WITH {_LENGTHS.format(cap=0).replace("JOIN (SELECT review_id AS r FROM ex WHERE exclusion_kind IS NULL) ON r = review_id", "")},
      b AS (SELECT review_id, sum(1 + strlen(text) + 1) AS body, count(*) FILTER (WHERE kind = 'add') AS additions, count(*) FILTER (WHERE kind = 'delete') AS deletions FROM dl GROUP BY review_id)
      SELECT review_id, CAST(head + hunk_head + body AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS hunks, additions, deletions FROM b JOIN h USING (review_id)""",
    "changed_lines": f"""WITH {V.V2}, k AS (SELECT review_id, CASE kind WHEN 'add' THEN 'RIGHT' ELSE 'LEFT' END AS side, path, CASE kind WHEN 'add' THEN new_line ELSE old_line END AS line FROM dl WHERE kind IN ('add', 'delete')) {_ISLANDS.format(t='k')}""",
    "ledger_ranges": f"WITH {V.V5} {_ISLANDS.format(t='(SELECT * FROM ledger WHERE line > 0)')}",
    "chunk_plan": f"""WITH RECURSIVE {_LENGTHS.format(cap=6000)}, {_next_fit("SELECT review_id, line_no AS k, n, head + hunk_head AS base FROM ln WHERE review_id NOT IN (SELECT review_id FROM bad)", "review_id", 6000)}
      SELECT review_id, CAST(g AS BIGINT) AS chunk_index, count(*) AS lines, 'f0000:h0000:l' || lpad(CAST(min(k) - 1 AS VARCHAR), 6, '0') AS first_line, 'f0000:h0000:l' || lpad(CAST(max(k) - 1 AS VARCHAR), 6, '0') AS last_line FROM fit GROUP BY review_id, g""",
    "chunk_errors": f"WITH {_LENGTHS.format(cap=600)} SELECT review_id, 'one diff line in ' || path || ':1:1:h000 cannot fit max_chars=600' AS error FROM bad JOIN h USING (review_id)",
    "chunk_sizes": f"""WITH RECURSIVE {_LENGTHS.format(cap=20000)}, {_next_fit("SELECT review_id, line_no AS k, n, head + hunk_head AS base FROM ln WHERE review_id NOT IN (SELECT review_id FROM bad)", "review_id", 20000)}
      , s AS (SELECT fit.review_id, g, sum(n) AS n, max(head + hunk_head) AS base FROM fit JOIN ln ON ln.review_id = fit.review_id AND ln.line_no = fit.k GROUP BY fit.review_id, g)
      SELECT review_id, CAST(sum(n + base) AS BIGINT) AS chars, count(*) AS chunks, true AS within FROM s GROUP BY review_id""",
    "chunk_ids": f"""WITH {V.V2}, x AS (SELECT review_id, path, path || ':1:1:h000' AS h, count(*) AS lines FROM dl JOIN ex USING (review_id, path) WHERE exclusion_kind IS NULL GROUP BY ALL),
      y AS (SELECT *, h || ':s0000-' || sha256(h || chr(0) || '0')[:12] AS segment_id FROM x) SELECT review_id, 'f0000:c0000-' || sha256(path || chr(0) || '0' || chr(0) || segment_id)[:12] AS chunk_id, segment_id, lines FROM y""",
    "partition_check": f"""WITH {V.V2} SELECT review_id, {SRC_ID} AS source_id, CAST(1 AS BIGINT) AS expected, CAST(0 AS BIGINT) AS found FROM dl JOIN ex USING (review_id, path) WHERE exclusion_kind IS NULL AND line_no = 4""",
    "batch_plan": f"""WITH RECURSIVE {V.V8}, {_next_fit("SELECT conv_id, k, n, 0 AS base FROM it", "conv_id", 2000, 2)},
      m AS (SELECT fit.conv_id, g, list('c' || turn ORDER BY fit.k) AS ids, sum(n) + 2 * (count(*) - 1) AS chars FROM fit JOIN it ON it.conv_id = fit.conv_id AND it.k = fit.k GROUP BY fit.conv_id, g)
      SELECT conv_id AS review_id, CAST(g AS BIGINT) AS batch_index, CASE WHEN len(ids) = 1 THEN ids[1] ELSE 'b' || lpad(CAST(g AS VARCHAR), 4, '0') || '-' || sha256('["' || array_to_string(ids, '","') || '"]')[:12] END AS batch_id,
             array_to_string(ids, ',') AS chunk_ids, CAST(chars AS BIGINT) AS patch_chars FROM m""",
    "budget_split": f"""WITH {V.V8}, f AS (SELECT conv_id, turn, k, count(*) OVER w AS c, greatest(0, 1000 - sum(length('### CONTEXT c' || turn || ' (' || role || ')') + 1) OVER w - 2 * (count(*) OVER w - 1)) AS free FROM it WINDOW w AS (PARTITION BY conv_id))
      SELECT conv_id, turn, CAST(free // c + CASE WHEN k <= free % c THEN 1 ELSE 0 END AS BIGINT) AS budget FROM f""",
    "fair_share": f"""WITH RECURSIVE {V.V8}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n, turn) AS r, count(*) OVER (PARTITION BY conv_id) AS c FROM it),
      lv AS (SELECT *, greatest(0, 1500 - 2 * (c - 1)) AS total, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
      ok AS (SELECT *, bool_and(n <= (total - before) // (c - r + 1) AND total >= before) OVER (PARTITION BY conv_id ORDER BY r) AS fits FROM lv),
      t AS (SELECT *, total - coalesce(sum(n) FILTER (WHERE fits) OVER (PARTITION BY conv_id), 0) AS rest, count(*) FILTER (WHERE NOT fits) OVER (PARTITION BY conv_id) AS waiting,
            count(*) FILTER (WHERE NOT fits) OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM ok)
      SELECT conv_id, turn, CAST(CASE WHEN fits THEN n ELSE rest // waiting + CASE WHEN nth <= rest % waiting THEN 1 ELSE 0 END END AS BIGINT) AS allocation FROM t""",
    "skip_fit_render": f"""WITH RECURSIVE {V.V8}, f(conv_id, k, used, kept) AS (
        SELECT conv_id, k, CASE WHEN n <= 1200 THEN n ELSE 0 END, n <= 1200 FROM it WHERE k = 1
        UNION ALL SELECT it.conv_id, it.k, CASE WHEN f.used + it.n <= 1200 THEN f.used + it.n ELSE f.used END, f.used + it.n <= 1200 FROM f JOIN it ON it.conv_id = f.conv_id AND it.k = f.k + 1)
      SELECT conv_id, turn, kept FROM f JOIN it USING (conv_id, k)""",
    "prefix_fit": f"WITH {V.V8} SELECT conv_id, turn FROM (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM it) WHERE used <= 1200",
    "anchor_excerpts": f"""WITH {V.V1}, a AS (SELECT path, line_no AS line FROM v1),
      e AS (SELECT a.path || ':' || line AS finding, string_agg(lpad(CAST(line_no AS VARCHAR), 6, ' ') || ' | ' || text, chr(10) ORDER BY line_no) AS x FROM a JOIN v1 ON v1.path = a.path AND line_no BETWEEN line - 2 AND line + 2 GROUP BY a.path, line)
      SELECT finding, sha256(x) AS excerpt_sha256, length(x) AS chars FROM e""",
    "risk_cues": f"""WITH {V.V1} SELECT commit_sha AS review_id, doc_id || ':risk:00' AS hypothesis_id, doc_id || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.py' END AS path, CAST(min(line_no) AS BIGINT) AS line,
      CASE doc_id % 3 WHEN 0 THEN 'forEach with an async callback' WHEN 1 THEN 'async map that nothing here gathers' ELSE 'value put into the text of a database call' END AS cue
      FROM v1 WHERE line_no % 11 = 0 AND (doc_id % 3 = 2 OR doc_id % 2 = 0) GROUP BY commit_sha, doc_id""",
}
