"""Near duplicates by SimHash, linked through a segment-popcount embedding.

A fingerprint of 64 bits is cut in 32 segments of two bits; its embedding is the number of
set bits in each. The Manhattan distance of two embeddings is at most the Hamming distance
of the fingerprints. Two embeddings within 3 have one half (16 segments) within 1, so a
fingerprint is put in the grid cell of each half, and looks in its own cell and in those
one step up along each segment; the lower of two neighbours finds the upper. What meets in
a cell is compared by Manhattan distance, then by exact Hamming distance.

Equal fingerprints are one node. In each cell all nodes near its least one are linked to
that first; then only links between different components are sought, so that a dense group
never gives all its pairs.

Defined cases: a null text, or one without words, has fingerprint 0 and is linked like any
other; one or two words are one shingle; rows that share a doc_id are one document; rows
without doc_id get the component of an equal fingerprint, or none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 16  # in each half
#: The low bit of each segment, in a signed long.
LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """As a signed long, the bits that are set in over half the 64-bit hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in common.slices(batches):
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", F.pandas_udf(run, "long")(F.col("text")).alias("fp"))


def _embedding(fp: Column) -> Column:
    """The popcount of each segment in unary: 00, 01 or 11. Their Hamming distance is the Manhattan distance."""
    up = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    low = fp.bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(up).bitwiseOR(F.shiftleft(low.bitwiseAND(up), 1))


def _halves(e: Column) -> list[Column]:
    return [e.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(e, 32)]


def _own(e: Column) -> Column:
    return F.array(*[F.struct(F.lit(g).alias("half"), cell.alias("cell")) for g, cell in enumerate(_halves(e))])


def _reach(e: Column) -> Column:
    """The own cell of each half and those one step up along a segment."""
    cells = []
    for g, cell in enumerate(_halves(e)):
        cells.append(F.struct(F.lit(g).alias("half"), cell.alias("cell")))
        for i in range(SEGMENTS):
            one, two = 1 << (2 * i), 2 << (2 * i)
            up = F.when(cell.bitwiseAND(F.lit(one)) == 0, cell + F.lit(one)).when(cell.bitwiseAND(F.lit(two)) == 0, cell + F.lit(two))
            cells.append(F.struct(F.lit(g).alias("half"), up.alias("cell")))
    return F.array(*cells)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked_nodes(nodes: DataFrame, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, fp, label) for nodes (node, fp): label is the least node reached over links of at most MAX_BITS bits.

    verify, if given, takes pairs (a, b) of nodes and returns those that count as links.
    """
    cells = nodes.select("fp", "node", F.explode(_own(_embedding(F.col("fp")))).alias("c")).select("fp", "node", "c.half", "c.cell")
    # the stars: each node of a cell and the cell's least
    hubs = cells.groupBy("half", "cell").agg(F.min(F.struct("fp", "node")).alias("hub")).select("half", "cell", F.col("hub.fp").alias("hub_fp"), F.col("hub.node").alias("hub"))
    stars = cells.join(hubs, ["half", "cell"]).where((F.col("node") != F.col("hub")) & (_apart("fp", "hub_fp") <= MAX_BITS)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = connected_components(stars if verify is None else verify(stars)).withColumnRenamed("node", "_n")
    nodes = common.stored(nodes.join(near, F.col("node") == F.col("_n"), "left").select("fp", "node", F.coalesce("label", "node").alias("label")), "simhash_stars")
    # the rest: links between different components
    held = nodes.select("fp", "node", "label", F.explode(_own(_embedding(F.col("fp")))).alias("c")).select("c.half", "c.cell", "fp", "node", "label")
    seek = nodes.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.col("label").alias("label2"), F.explode(_reach(_embedding(F.col("fp")))).alias("c")).select("c.half", "c.cell", "fp2", "node2", "label2").where("cell is not null")
    met = held.join(seek, ["half", "cell"]).where((F.col("label") != F.col("label2")) & (F.bit_count(_embedding(F.col("fp")).bitwiseXOR(_embedding(F.col("fp2")))) <= MAX_BITS) & (_apart("fp", "fp2") <= MAX_BITS))
    links = met.select(F.col("label").alias("a"), F.col("label2").alias("b"))
    if verify is not None:
        pairs = verify(met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())
        links = pairs.unionByName(nodes.where("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b")))
    last = connected_components(links).select(F.col("node").alias("_n"), F.col("label").alias("least"))
    return nodes.join(last, F.col("label") == F.col("_n"), "left").select("node", "fp", F.coalesce("least", "label").alias("label"))


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of prints (doc_id, fp)."""
    nodes = common.stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash_nodes")
    return linked_nodes(nodes).select("fp", F.col("label").alias("component_id"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = common.stored(fingerprints(docs), "simhash_prints")
    return prints.join(components(prints), "fp", "left").select("doc_id", "fp", "component_id")



def keep_first(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component; same columns, one row for each doc_id."""
    return common.firsts(docs, linked(docs))
