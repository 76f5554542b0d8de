"""Benchmark decontamination: size-partitioned MinHash containment search, without UDFs.

A text is its lower-cased words (runs of letters and digits); its set is the distinct
shingles of five words. An item of fewer words is the one shingle of them all, and documents
are looked through for runs of as many words, whichever such lengths the items have; an item
without words is never reported. An item is in a document if at least ``threshold`` of its shingles are.

Items are partitioned by size (powers of two). The sketch of an item is its least MinHash
values, as many as its partition needs: a document that holds ``threshold`` of q shingles
misses at most q - ceil(threshold q) of them, so one more than that many values, whichever,
always has one in the document. For the partition's largest q this number is the sketch's
length, and its smallest q gives the least number of shingles of a document that is looked
at. Documents, long or short, are only looked up in this index; what is found is verified
by the exact overlap of the shingles themselves. There are no misses.

The index and the ids of what it finds are broadcast while they are made of at most
``BROADCAST_ROWS`` rows, and joined by a shuffle beyond. Defined cases: null texts have no words; rows of a table that share an id
are one document or item (the best containment counts); rows without id are not reported;
a document in which several items are found has a row for each; texts are taken whole, however
long; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _runs(text: Column, sizes: Sequence[int], fn: Callable[[list[Column]], Column]) -> Column:
    """The distinct values of fn over the runs of so many words of the text, for each of the sizes.

    The words are bound once: no rewrite of the plan can put their split inside the loops.
    """

    def of(w: Column, size: int) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: fn([F.get(w, i + k) for k in range(size)]))

    parts = lambda w: [of(w, size) for size in sizes]
    return F.array_distinct(F.get(F.transform(F.array(words(text)), lambda w: F.concat(*p) if len(p := parts(w)) > 1 else p[0]), 0))


def _hash(w: list[Column]) -> Column:
    return F.xxhash64(*w)


def _join(w: list[Column]) -> Column:
    return F.concat_ws(" ", *w)


def _of_item(text: Column, fn: Callable[[list[Column]], Column]) -> Column:
    """fn of the shingles of an item: five words, or all of fewer."""
    n = F.size(words(text))
    some = F.lit(None)
    for size in range(1, SHINGLE):
        some = F.when(n == size, _runs(text, [size], fn)).otherwise(some)
    return F.when(n >= SHINGLE, _runs(text, [SHINGLE], fn)).otherwise(some)


def sizes_of(items: DataFrame) -> list[int]:
    """The lengths of the items' shingles: at most five numbers."""
    n = F.least(F.size(words(F.col("text"))), F.lit(SHINGLE))
    return sorted(r.n for r in items.select(n.alias("n")).distinct().collect() if r.n) or [SHINGLE]


def _ceil(x: Column) -> Column:
    """Ceiling that a rounding error of the product does not lift."""
    return F.ceil(x - 1e-9)


def index(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(hash, item_id, least): the sketch of each item, and the least size of a document for it."""
    sets = items.where("item_id is not null").select("item_id", _of_item(F.col("text"), _hash).alias("h")).where("h is not null")
    low = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.size("h"), F.lit(1))))).cast("long")
    high = 2 * low - 1
    length = (high - _ceil(F.lit(threshold) * high) + 1).cast("int")
    sketch = F.slice(F.array_sort("h"), F.lit(1), length)
    return sets.select("item_id", _ceil(F.lit(threshold) * low).alias("least"), F.explode_outer(sketch).alias("hash")).where("hash is not null").distinct()


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it is made of few enough rows; if not, its joins shuffle, always by merging."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (doc_id, item_id) that the sketches leave."""
    found = common.stored(index(items, threshold), "decontam_index")
    found = _bounded(found, found.count())
    sets = docs.where("doc_id is not null and text is not null").select("doc_id", _runs(F.col("text"), sizes_of(items), _hash).alias("h"))
    rows = sets.select("doc_id", F.size("h").alias("n"), F.explode_outer("h").alias("hash"))
    return rows.join(found, "hash").where("n >= least").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): pairs with at least threshold of the item's shingles in the document."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    pairs = common.stored(candidates(docs, items, threshold), "decontam_pairs")
    by_doc = _bounded(pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("found")), pairs.count())
    sets = docs.join(by_doc, "doc_id").select("doc_id", "found", _runs(F.col("text"), sizes_of(items), _join).alias("s"))
    rows = sets.select("doc_id", "s", F.explode_outer("found").alias("item_id"))
    wanted = items.select("item_id", _of_item(F.col("text"), _join).alias("q"))
    shared = rows.join(wanted, "item_id").select("doc_id", "item_id", F.size("q").cast("long").alias("n_item"), F.size(F.array_intersect("s", "q")).cast("long").alias("n_shared"))
    best = shared.where(F.col("n_shared") >= _ceil(F.lit(threshold) * F.col("n_item"))).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item; same columns."""
    hits = common.stored(contained(docs, items, threshold).select(F.col("doc_id").alias("_id")).distinct(), "decontam_hits")
    return common.replaced(common.packed(docs, _id=F.col("doc_id")).join(_bounded(hits, hits.count()), "_id", "left_anti"), docs)
