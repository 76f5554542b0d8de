"""op10: benchmark items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, decontam


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: Words of a table's texts with the four that follow: (id, pos, n, w, w1 to w4).
WORDS = """
SELECT id, w, row_number() OVER o AS pos, count(*) OVER (PARTITION BY id) AS n, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
FROM (
  SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS nth
  FROM (SELECT {id} AS id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS l FROM {table}))
WHERE w <> ''
WINDOW o AS (PARTITION BY id ORDER BY nth)
"""
#: The distinct shingles (id, g) of k words each.
RUNS = "SELECT DISTINCT id, CASE k WHEN 5 THEN concat_ws(' ', w, w1, w2, w3, w4) WHEN 4 THEN concat_ws(' ', w, w1, w2, w3) WHEN 3 THEN concat_ws(' ', w, w1, w2) WHEN 2 THEN concat_ws(' ', w, w1) ELSE w END AS g FROM {words} WHERE pos + k - 1 <= n"

QUERIES = {"op10_decontam": op10_decontam}
ORACLE = {
    "op10_decontam": f"""
WITH dw AS ({WORDS.format(id="doc_id", table="documents")}),
qw AS ({WORDS.format(id="item_id", table="benchmark")}),
qs AS ({RUNS.format(words="(SELECT *, least(n, 5) AS k FROM qw)")}),
ds AS ({RUNS.format(words="dw, (SELECT DISTINCT least(n, 5) AS k FROM qw) AS ks")}),
sizes AS (SELECT id, count(*) AS n_item FROM qs GROUP BY id)
SELECT ds.id AS doc_id, qs.id AS item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM ds JOIN qs USING (g) JOIN sizes ON sizes.id = qs.id GROUP BY ALL HAVING count(*) >= ceil(0.8 * n_item - 1e-9)
"""
}
