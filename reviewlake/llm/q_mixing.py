"""op11: how many words of every document a mix of all sources takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, mixing


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(common.table(spark, sf_dir, "documents"))


QUERIES = {"op11_mixing": op11_mixing}
ORACLE = {
    "op11_mixing": """
WITH sized AS (
  SELECT row_number() OVER () AS id, doc_id, source, md5(coalesce(doc_id::VARCHAR, text, ''))[:16] AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, (nth - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM sources),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM weighed WINDOW o AS (ORDER BY source_size * 6 / w, nth)),
limited AS (SELECT *, cap * (ws - used) <= w * (total - caps) AS stops FROM ranked),
goals AS (
  SELECT *, CASE WHEN stops THEN cap::DOUBLE ELSE w::DOUBLE * (total - coalesce(sum(cap) FILTER (WHERE stops) OVER (), 0))::DOUBLE / (ws - coalesce(sum(w) FILTER (WHERE stops) OVER (), 0))::DOUBLE END AS target
  FROM limited),
copies AS (
  SELECT id, size, nth, source_size, target, e, md5(key || ':' || e)[:16] AS turn
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source, (SELECT unnest(range(3)) AS e)
  WHERE size > 0 AND e < ceil(target / source_size)),
queued AS (
  SELECT *, (sum(size) OVER (PARTITION BY nth ORDER BY e, turn, size ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish FROM copies),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, nth, turn, size ROWS UNBOUNDED PRECEDING) AS place FROM queued),
used AS (SELECT id, sum(size) AS taken, count(*) AS n FROM served WHERE place <= (SELECT sum(size) FROM sized) GROUP BY id)
SELECT doc_id, size, goals.source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n, 0)::BIGINT AS copies_taken
FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source LEFT JOIN used USING (id)
"""
}
