"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

State (tables in the shared folder):

* ``holders`` - one row for each (line key, document): the exact reference table;
* ``counts``  - for each key held by two or more documents: their number and the smallest;
* ``filters`` - one cuckoo filter for each shard of the keys in ``counts``.

A key enters its shard's filter when its count reaches two and leaves it when the count
falls below two, so inserts and deletions of documents can follow in any order. A line
that its filter does not know is held once and needs no lookup; the others are looked up
in the exact counts, so that false positives of a filter change nothing. Filters are not
gathered anywhere: lines go to their shard's filter in as many parts as the shard has millions of lines, so a common
line is spread, and a task holds one filter at a time. A filter that fills up is built anew from its shard's counts with more room;
when the shared keys have outgrown the shards, all are, with more of them.

Defined cases: a null or empty text is one empty line; lines under ``min_chars`` code
points and rows without doc_id neither count nor lose lines; rows that share a doc_id
are one document, and of these all rows keep or lose a line alike; a line that repeats within
one document alone stays; a text of very many lines costs time in proportion to them;
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .cuckoo import CuckooFilter

MIN_CHARS = 10
#: Keys in one shard's filter, about.
SHARD_KEYS = 200_000
#: Lines that meet a copy of their shard's filter in one part; a shard has as many parts as its lines need.
PART_LINES = 2_000_000
#: Load at which a filter is built anew from its shard's counts, with more room.
MOST_LOAD = 0.9


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.btrim(line, F.lit(common.TRIMMED)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> Column:
    """128 bits: equal keys and, for any real corpus, no others."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


@dataclass
class LineState:
    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int


def holders_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
    rows = docs.select("doc_id", "text").where("doc_id is not null").select("doc_id", F.explode(keys).alias("key"))
    return rows.select(_hashes(F.col("key")).alias("k"), "doc_id").select("k.h1", "k.h2", "doc_id")


def _counts(holders: DataFrame) -> DataFrame:
    per_key = holders.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return per_key.where("first_doc < last_doc").drop("last_doc")


def _shard(n: int) -> Column:
    return F.pmod(F.col("h2"), F.lit(n))


FILTER = "shard long, filter binary, load double"


def _filters(counts: DataFrame, n_shards: int) -> DataFrame:
    def build(group: pa.Table) -> pa.Table:
        h = group.column("h1").to_numpy().view(np.uint64)
        made = CuckooFilter.sized(len(h))
        made.add(h)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary()), "load": pa.array([made.load])})

    keys = counts.select(_shard(n_shards).alias("shard"), "h1")
    return keys.groupBy("shard").applyInArrow(build, FILTER)


def _n_shards(counts: DataFrame) -> int:
    return max(1, -(-counts.count() // SHARD_KEYS))


def _state(holders: DataFrame) -> LineState:
    counts = common.stored(_counts(holders), "line_counts")
    n_shards = _n_shards(counts)
    return LineState(holders, counts, common.stored(_filters(counts, n_shards), "line_filters"), n_shards)


def insert(state: LineState | None, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineState:
    """The state after these documents join it (those that it already has are not counted twice)."""
    new = common.stored(holders_of(docs, min_chars), "line_holders")
    if state is None:
        return _state(new)
    fresh = new.join(state.holders, ["h1", "h2", "doc_id"], "left_anti")
    return _changed(state, state.holders.unionByName(fresh), fresh)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state after the documents in doc_ids (column doc_id) leave it."""
    ids = doc_ids.select("doc_id").distinct()
    gone = state.holders.join(ids, "doc_id", "left_semi").select("h1", "h2", "doc_id")
    return _changed(state, state.holders.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id"), gone)


def _changed(state: LineState, holders: DataFrame, touched: DataFrame) -> LineState:
    """Counts anew for the touched keys alone; filters take in what was first shared and let go what no longer is."""
    holders = common.stored(holders, "line_holders")
    keys = touched.select("h1", "h2").distinct()
    anew = _counts(holders.join(keys, ["h1", "h2"], "left_semi"))
    counts = common.stored(state.counts.join(keys, ["h1", "h2"], "left_anti").unionByName(anew), "line_counts")
    n_shards = _n_shards(counts)
    if n_shards > 2 * state.n_shards:
        return LineState(holders, counts, common.stored(_filters(counts, n_shards), "line_filters"), n_shards)
    signed = (
        counts.join(state.counts, ["h1", "h2"], "left_anti").select(_shard(state.n_shards).alias("shard"), "h1", F.lit(1).alias("sign"))
    ).unionByName(state.counts.join(counts, ["h1", "h2"], "left_anti").select(_shard(state.n_shards).alias("shard"), "h1", F.lit(-1).alias("sign")))

    def merge(old: pa.Table, moves: pa.Table) -> pa.Table:
        h = moves.column("h1").to_numpy().view(np.uint64)
        sign = moves.column("sign").to_numpy()
        shard = (old if old.num_rows else moves).column("shard")[0].as_py()
        made = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.sized(2 * len(h))
        made.remove(h[sign < 0])
        made.add(h[sign > 0])
        return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary()), "load": pa.array([made.load])})

    filters = common.stored(state.filters.groupBy("shard").cogroup(signed.groupBy("shard")).applyInArrow(merge, FILTER), "line_filters")
    full = filters.where(F.col("load") > MOST_LOAD).select("shard")
    if not full.isEmpty():
        keys = counts.withColumn("shard", _shard(state.n_shards)).join(full, "shard", "left_semi").drop("shard")
        filters = common.stored(filters.join(full, "shard", "left_anti").unionByName(_filters(keys, state.n_shards)), "line_filters")
    return LineState(holders, counts, filters, state.n_shards)


def maybe_shared(state: LineState, rows: DataFrame) -> DataFrame:
    """Rows (h1, h2, doc_id) whose key the filter of its shard may know."""
    id_type = rows.schema["doc_id"].dataType
    parts = rows.groupBy(_shard(state.n_shards).alias("shard")).agg(F.ceil(F.count("*") / PART_LINES).cast("int").alias("parts"))
    parts = common.stored(parts, "line_parts")
    filters = state.filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "filter", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(None).cast(id_type).alias("doc_id"))
    lines = rows.withColumn("shard", _shard(state.n_shards)).join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "h1", "h2", "doc_id")
    met = filters.unionByName(lines).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of = None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            keep = np.zeros(len(shard), bool)
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] == 0), True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if kind[a] == 0:
                    known, of, a = CuckooFilter.from_bytes(batch.column("filter")[int(a)].as_py()), shard[a], a + 1
                if known is not None and of == shard[b - 1] and a < b:
                    keep[a:b] = known.contains(batch.column("h1").slice(a, b - a).to_numpy().view(np.uint64))
            yield batch.select(["h1", "h2", "doc_id"]).filter(pa.array(keep))

    return met.mapInArrow(probe, rows.schema)


def _places(lines: Column, gone: Column) -> Column:
    """Places, from 0, of those lines whose hash is in gone."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hashes, drops in batches:
            yield pd.Series([np.flatnonzero(np.isin(h, d)).astype(np.int32) if len(d) else np.zeros(0, np.int32) for h, d in zip(hashes, drops, strict=True)])

    return F.pandas_udf(run, "array<int>")(lines, gone)


def apply(docs: DataFrame, state: LineState, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs as struct ``_row`` with n_lines, n_dropped and kept_text: shared lines stay in their smallest document alone."""
    none = F.array().cast("array<long>")
    drops = (
        maybe_shared(state, state.holders)
        .join(state.counts, ["h1", "h2"])
        .where("doc_id <> first_doc")
        .groupBy("doc_id")
        .agg(F.collect_list(F.xxhash64("h1", "h2")).alias("_gone"))
        .withColumnRenamed("doc_id", "_id")
    )
    rows = common.packed(docs, _id=F.col("doc_id"), _text=F.col("text")).join(drops, "_id", "left")
    lines = _lines(F.col("_text"))

    def hashed(line: Column) -> Column:
        k = _hashes(line_key(line))
        return F.xxhash64(k["h1"], k["h2"])

    hashes = F.when(F.col("_gone").isNotNull(), F.transform(lines, hashed)).otherwise(none)
    rows = rows.withColumn("_places", _places(hashes, F.coalesce("_gone", none)))
    n, gone = F.size(lines), F.col("_places")

    def between(i: Column) -> Column:
        """The lines that stay before the i-th one that goes."""
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        return F.slice(lines, start + 1, F.when(i == F.size(gone), n).otherwise(F.get(gone, i)) - start)

    kept = F.when(F.size(gone) == 0, F.coalesce(F.col("_text"), F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between)), "\n"))
    return rows.select("_row", n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with the lines dropped that an earlier document holds; same columns."""
    done = apply(docs, insert(None, docs, min_chars), min_chars)
    return common.replaced(done, docs, text=F.when(F.col("_row.text").isNotNull(), F.col("kept_text")))
