"""op13: the prefix trie of all conversations, of which those of twenty ids begin with turns of the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, trie


def rebuilt(paths: DataFrame) -> DataFrame:
    """paths in which the first h turns are those of the conversation with the last id divisible by 20, h by crc32 of the own id."""
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    lead = F.col("conv_id") - F.col("conv_id") % 20
    heads = paths.where("conv_id % 20 = 0").select(F.col("conv_id").alias("lead"), F.substring("path", 1, 3 * trie.TURN).alias("lead_path"), F.slice("words", 1, 3).alias("lead_words"))
    both = paths.withColumn("h", h.cast("int")).withColumn("lead", lead).join(heads, "lead", "left")
    none = F.expr("cast(array() as array<int>)")
    path = F.concat(F.substring(F.coalesce("lead_path", F.lit(b"")), F.lit(1), F.col("h") * trie.TURN), F.substring("path", F.col("h") * trie.TURN + 1, F.greatest(F.length("path"), F.lit(1))))
    words = F.concat(F.slice(F.coalesce("lead_words", none), F.lit(1), F.col("h")), F.slice("words", F.col("h") + 1, F.greatest(F.size("words"), F.lit(1))))
    return both.select("conv_id", path.alias("path"), words.alias("words"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations")
    return trie.nodes(rebuilt(common.stored(trie.paths(turns), "turn_paths")))


#: crc32 of a number's decimal digits: eight steps for each.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

QUERIES = {"op13_trie": op13_trie}
ORACLE = {
    "op13_trie": f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT *, {CRC32} % 4 AS h FROM turns),
built AS (
  SELECT t.conv_id, list_concat(coalesce(l.ts, [])[:t.h], t.ts[t.h + 1:]) AS ts
  FROM hashed AS t LEFT JOIN turns AS l ON l.conv_id = t.conv_id - t.conv_id % 20),
prefixes AS (SELECT conv_id, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM built),
members AS (SELECT conv_id, n, depth, ts[:depth] AS path FROM prefixes),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
weighed AS (SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own FROM nodes),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
sized AS (SELECT weighed.*, coalesce(n_children, 0) AS n_children FROM weighed LEFT JOIN children USING (path)),
below AS (
  SELECT up, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM (SELECT path[:d] AS up, n_children, own FROM (SELECT *, unnest(range(depth + 1)) AS d FROM sized)) GROUP BY up)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, s.ends_sha256
FROM sized AS s JOIN below ON below.up = s.path LEFT JOIN nodes AS p ON s.depth > 0 AND p.path = s.path[:s.depth - 1]
"""
}
