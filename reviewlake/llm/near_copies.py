"""Near copies by exact set similarity: the stage's own parameters, five words and 0.8.

A text is its ASCII-lower-cased words; its set is the distinct 64-bit hashes of its shingles
of five words (of fewer words: the one shingle of them all; of none: empty). Two documents are
linked if the Jaccard similarity of their sets is at least 0.8, and one document of each
component of links stays. Sets are known by a 64-bit hash of all their shingles.

First the SimHash operator links what lies within its bits: each set has a fingerprint of its
shingles, fingerprints meet in the popcount grid, and what meets is verified by the exact overlap.
That settles copies, and near copies of few changes, whatever their number.

At a similarity of 0.8 fingerprints differ in 10 bits of 64 on average and in 14 at times, where
the grid would compare a fixed share of all pairs. So that no link is lost, the rest are sought
between different components by a prefix filter, which misses nothing: in any one order of
shingles, two sets of similarity t share one of the first n - ceil(t n) + 1 of each. The order puts
shingles that are frequent in a sample of the documents last, so that few sets meet at a shingle. It
decides only how many candidates there are. Where two sets first meet, the shingles left in each
bound their overlap; what passes that bound goes if the parities of the shingle counts in twice
as many buckets as shingles differ in more buckets than the sets may differ in shingles. Both are
exact; the others are checked by the exact overlap. At a shingle, of two sets one is never of the
largest component there, so that a dense group does not give all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: One in so many sets is sampled; shingles of so many sampled sets are frequent, and so many of them are ordered.
SAMPLE, FREQUENT, ORDERED = 16, 4, 500_000
BROADCAST_ROWS = 500_000
#: Least number of buckets of a set's parities.
BUCKETS = 1024
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending, as signed longs."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    h = np.full(len(x) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ x[i : i + len(h)]) * ODD
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def set_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of a power of two of buckets, twice as many as shingles at least, whether it holds an odd number of them."""
    m = max(BUCKETS, 1 << (2 * len(shingles)).bit_length())
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(20)).astype(np.int64) % m, minlength=m)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> int:
    """Buckets in which parities differ, of which the longer are folded to the length of the shorter."""
    while len(p) != len(q):
        if len(p) < len(q):
            p, q = q, p
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return int(np.bitwise_count((p ^ q).view(np.uint64)).sum())


def prefix_length(n: int) -> int:
    return n - int(np.ceil(THRESHOLD * n - 1e-9)) + 1 if n else 0


def _keyed(text: Column) -> Column:
    """k, n, fingerprint and parities of a set, and the set if it is in the sample."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in common.slices(batches):
            sets = [shingle_set(t) for t in texts]
            keys = [set_key(s) for s in sets]
            yield pd.DataFrame({"k": keys, "n": [len(s) for s in sets], "fp": [simhash.majority(s.view(np.uint64)) for s in sets], "p": [parities(s) for s in sets], "sample": [s if k % SAMPLE == 0 else None for s, k in zip(sets, keys, strict=True)]})

    return F.pandas_udf(run, "k long, n int, fp long, p array<long>, sample array<long>")(text)


def _prefixed(text: Column, shared: Broadcast) -> Column:
    """k and n of a set and the first of its shingles: those not frequent by hash, then the others from rare to frequent."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, rank = shared.value
        for texts in common.slices(batches):
            rows = []
            for text in texts:
                s = shingle_set(text)
                order = np.arange(len(s))
                if len(hashes) and len(s):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    order = np.argsort(np.where(hashes[at] == s, rank[at], 0), kind="stable")
                rows.append((set_key(s), len(s), s[order[: prefix_length(len(s))]]))
            yield pd.DataFrame(rows, columns=["k", "n", "prefix"])

    return F.pandas_udf(run, "k long, n int, prefix array<long>")(text)


def _apart(pa: Column, pb: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ps, qs in batches:
            yield pd.Series([apart(p, q) for p, q in zip(ps, qs, strict=True)], dtype="int64")

    return F.pandas_udf(run, "long")(pa, pb)


def _sets(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in common.slices(batches):
            sets = [shingle_set(t) for t in texts]
            yield pd.DataFrame({"k": [set_key(s) for s in sets], "h": sets})

    return F.pandas_udf(run, "k long, h array<long>")(text)


def _frequent(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of the sample, ascending, and their ranks from 1: at most ORDERED rows come to the driver."""
    sampled = keyed.where("sample is not null").select("k", "sample").dropDuplicates(["k"])
    counts = sampled.select(F.explode("sample").alias("h")).groupBy("h").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "h").limit(ORDERED).toPandas()
    hashes = rows.h.to_numpy(np.int64)
    by_hash = np.argsort(hashes)
    return hashes[by_hash], (len(hashes) - np.arange(len(hashes), dtype=np.int64))[by_hash]


def _similar(pairs: DataFrame, docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar, by exact overlap."""
    ids = keyed.groupBy("k").agg(F.min("doc_id").alias("_d"))
    sizes = keyed.select("k", "n", "p").dropDuplicates(["k"])
    a, b = (sizes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    near = F.least("na", "nb") >= F.lit(THRESHOLD) * F.greatest("na", "nb") - 1e-9
    # two sets of similarity t differ in (1 - t) / (1 + t) of their shingles
    close = _apart(F.col("pa"), F.col("pb")) <= (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col("na") + F.col("nb")) + 1e-9
    pairs = common.stored(pairs.join(a, "a").join(b, "b").where(near).where(close).select("a", "b", "na", "nb"), "near_pairs")
    keys = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    ids = common.stored(keys.join(ids, "k").select("_d").distinct(), "near_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")
    sets = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("_d"), "left_semi").select(_sets(F.col("text")).alias("s")).select("s.*")
    sets = common.stored(sets, "near_sets").dropDuplicates(["k"])
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("k").alias("b"), F.col("h").alias("hb")), "b")
    shared = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("c"))
    return shared.where(F.col("c") >= F.lit(THRESHOLD) * (F.col("na") + F.col("nb") - F.col("c")) - 1e-9).select("a", "b")


def _meetings(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """(h, k, n, i) for each distinct set and each of its first shingles that another set has too; i is its place."""
    prefixes = docs.select(_prefixed(F.col("text"), frequent).alias("s")).select("s.*").dropDuplicates(["k"])
    prefixes = common.stored(prefixes, "near_prefixes")
    rows = prefixes.select("k", "n", F.posexplode("prefix").alias("i", "h"))
    # stored, so that the join is free to split a hot shingle
    shared = common.stored(rows.groupBy("h").count().where(F.col("count") > 1).select("h"), "near_shared")
    return rows.join(shared, "h").select("h", "k", "n", "i")


def _rest(held: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets of different components that may be similar, of held (h, k, n, i, label)."""
    parts = held.groupBy("h", "label").count().groupBy("h").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rest = held.join(common.stored(parts.select("h", "most"), "near_parts"), "h")
    other = rest.where("label <> most").select("h", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("label").alias("label2"))
    t = F.lit(THRESHOLD)
    size = F.least("n", "n2") >= t * F.greatest("n", "n2") - 1e-9
    # the shingles from this one on bound the overlap where the sets first meet, and less at later ones
    overlap = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= t / (1 + t) * (F.col("n") + F.col("n2")) - 1e-9
    return rest.join(other, "h").where((F.col("label") != F.col("label2")) & size & overlap).select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text) with a doc_id."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    keyed = common.stored(docs.select("doc_id", _keyed(F.col("text")).alias("s")).select("doc_id", "s.*"), "near_keys")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(keyed))
    keyed = keyed.drop("sample")
    nodes = common.stored(keyed.select(F.col("k").alias("node"), "fp").dropDuplicates(["node"]), "near_nodes")
    close = common.stored(simhash.linked_nodes(nodes, lambda pairs: _similar(pairs, docs, keyed)).select(F.col("node").alias("k"), "label"), "near_simhash")
    held = common.stored(_meetings(docs, frequent).join(close, "k"), "near_held")
    links = close.where("label <> k").select(F.col("k").alias("a"), F.col("label").alias("b")).unionByName(_similar(_rest(held), docs, keyed))
    groups = connected_components(links).withColumnRenamed("node", "k")
    known = keyed.join(groups, "k", "left").select("doc_id", F.coalesce("label", "k").alias("g"))
    return known.join(known.groupBy("g").agg(F.min("doc_id").alias("component_id")), "g").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component; same columns, one row for each doc_id."""
    return common.firsts(docs, linked(docs))
