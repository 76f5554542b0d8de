"""Prefix trie of conversations: which beginnings they share, and what is saved if each is taken once.

A conversation is the sequence of its turns. All sequences are sorted and dealt out in ranges; consecutive ones, about
``TURNS`` turns at a time, are a shard. A shard encodes its turns by a dictionary, puts its distinct sequences in a ternary search
tree, the median first, so that the tree is balanced, and goes through its nodes once, from the last to the first, without
recursion, to add up members, leaves and savings. Nodes that a shard can share with the one before or behind it, the
common beginnings of neighbours, leave it as parts; their parts are added up, and what lies below them is added to all nodes above
in steps of doubling length, so that a long chain of such nodes takes few rounds.

Work: a turn is reduced to 16 bytes and a number of words in one pass over the texts; a conversation's
turns, in that form, meet in one row. Copies of a conversation are dealt out with their ids, so a third of all rows
being copies is many shards. Only the digest of a node's ids is a fold in order: pieces of a shard's ids pass through
one task with a fixed state, as SHA-256 can't be put together from parts.

Defined cases: a null role or text is empty; turns of a conversation go by turn, null first, then by the digest of role
and text; turns that repeat are turns each; rows without conv_id belong to no conversation and are left out;
a conversation without turns is a member of the root alone; no conversations give no nodes; other columns are not read,
whatever their names; a long text or a long conversation counts whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .mixing import tokens

#: Bytes of a turn's id, and turns of a shard.
TURN = 16
TURNS = 200_000
NOTHING = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of each conversation: ids of its turns one behind the other, and their numbers of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn"), turn.alias("id"), tokens(text).cast("int").alias("words")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: F.hex(t["id"])), "")).alias("path"), F.transform("ts", lambda t: t["words"]).alias("words"))


class SearchTree:
    """Ternary search tree over sequences of codes. Node 0 is the root; a node's parent in the trie has a smaller number."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _made(self, code: int, parent: int) -> int:
        for column, value in ((self.code, code), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.code) - 1

    def way(self, codes: list[int]) -> list[int]:
        """The nodes from the root to a sequence; those that are missing are made."""
        code, low, high, down = self.code, self.low, self.high, self.down
        way = [0]
        for c in codes:
            side, last = down, way[-1]
            at = side[last]
            while at >= 0 and code[at] != c:
                side, last = (low, at) if c < code[at] else (high, at)
                at = side[last]
            if at < 0:
                at = side[last] = self._made(c, way[-1])
            way.append(at)
        return way


def by_medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each part before its halves."""
    waiting = [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            waiting += [(middle + 1, b), (a, middle)]


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two paths begin with alike; of a path and one that is not known, all."""
    if a is None or b is None:
        return len(a or b or b"") // TURN
    n = min(len(a), len(b)) // TURN
    if not n:
        return 0
    differ = (np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)).reshape(n, 2).any(1)
    return int(differ.argmax()) if differ.any() else n


NODE = "shared boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string"
TYPES = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
FIELDS = [(x.split()[0], TYPES[x.split()[1]]) for x in NODE.split(", ")]


def shard_nodes(ids: list[int], sequences: list[bytes], words: list[list[int]], before: bytes | None, behind: bytes | None) -> pa.RecordBatch:
    """Nodes of conversations in order of (sequence, id); before and behind: the sequences beside them, None if not known.

    Shared nodes have what their own shard adds: members, and children, leaves and savings below that are not shared
    themselves; their ends are ids, those of other nodes a digest.
    """
    first = [i for i in range(len(ids)) if not i or sequences[i] != sequences[i - 1]]
    sizes = np.array([len(sequences[i]) // TURN for i in first], np.int64)
    codes = np.unique(np.frombuffer(b"".join(sequences[i] for i in first), f"S{TURN}"), return_inverse=True)[1].tolist()
    edges = np.r_[0, sizes.cumsum()].tolist()
    tree, ends = SearchTree(), {}
    for k in by_medians(len(first)):
        ends[tree.way(codes[edges[k] : edges[k + 1]])[-1]] = (first[k], first[k + 1] if k + 1 < len(first) else len(ids))
    n = len(tree.code)
    # nodes that neighbours can share: beginnings of the first or last sequence
    keys: dict[int, bytes] = {}
    for k, turns in ((0, common_turns(sequences[0], before)), (len(first) - 1, common_turns(sequences[-1], behind))):
        digest = hashlib.md5()
        for d, node in enumerate(tree.way(codes[edges[k] : edges[k] + turns])):
            digest.update(sequences[first[k]][TURN * (d - 1) : TURN * d] if d else b"")
            keys[node] = digest.copy().digest()
    members, least, children, leaves, saved, cost = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, (a, b) in ends.items():
        members[node], least[node] = b - a, ids[a]
    # a node's words are those of its turn in any sequence through it: the one of its first conversation
    parent, depth, source = tree.parent, tree.depth, [-1] * n
    for node, (a, _) in ends.items():
        source[node] = a
    for node in range(n - 1, 0, -1):
        up = parent[node]
        members[up] += members[node]
        least[up] = least[node] if least[up] is None else min(least[up], least[node])
        source[up] = source[node] if source[up] < 0 else source[up]
        cost[node] = words[source[node]][depth[node] - 1]
        if node not in keys:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * cost[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    listed = [None] * n
    for node, (a, b) in ends.items():
        listed[node] = ",".join(map(str, ids[a:b]))
    columns = {
        "shared": [i in keys for i in range(n)], "key": [keys.get(i) for i in range(n)], "parent_key": [None, *(keys.get(p) for p in parent[1:])], "conv_id": least, "depth": depth,
        "parent_conv_id": [None, *(None if p in keys else least[p] for p in parent[1:])], "n_convs": members, "n_children": children, "n_leaves": leaves, "saved": saved, "words": cost,
        "ends": [text if i in keys else NOTHING if text is None else hashlib.sha256(text.encode()).hexdigest() for i, text in enumerate(listed)],
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in FIELDS], names=[name for name, _ in FIELDS])


def shards(sorted_paths: DataFrame, turns: int = TURNS) -> DataFrame:
    """Nodes (NODE) of the shards of paths that are in order of (path, conv_id) within and across partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sequences, words, size, before = [], [], [], 0, None
        for batch in batches:
            for conv, path, counts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words")), strict=True):
                if size >= turns:
                    yield shard_nodes(ids, sequences, words, before, path)
                    ids, sequences, words, size, before = [], [], [], 0, sequences[-1]
                ids.append(conv)
                sequences.append(path)
                words.append(counts)
                size += len(counts) + 1
        if ids:
            yield shard_nodes(ids, sequences, words, before, None)

    return sorted_paths.select("conv_id", "path", "words").mapInArrow(run, NODE)


def added_up(nodes: DataFrame) -> DataFrame:
    """nodes (key, parent_key, leaves, saved) with the sums of all below each one added, in rounds that double the distance they reach."""
    spark = nodes.sparkSession
    now, path = common.stored_at(nodes.select("key", F.col("parent_key").alias("up"), "leaves", "saved"), "trie_sums")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        sums = now.join(below, "key", "left").select("key", "up", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        old = path
        now, path = common.stored_at(sums.join(above.where("_up is not null"), "up", "left").select("key", F.col("_up").alias("up"), "leaves", "saved"), "trie_sums")
        common.remove(spark, old)
    return now.select("key", "leaves", "saved")


def id_digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256) of pieces (key, first, ends): the digest of a key's pieces in order of first, with commas between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])
        for batch in batches:
            rows = []
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
                if key != last:
                    if digest:
                        rows.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.as_buffer())
            yield made(rows)
        if digest:
            yield made([(last, digest.hexdigest())])

    return pieces.select("key", "first", "ends").repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(conversation_paths: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of paths (conv_id, path, words).

    A node is known by its least member and its depth.
    """
    kept = common.stored(conversation_paths.select("conv_id", "path", "words"), "trie_paths")
    parts = common.stored(shards(kept.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"), turns), "trie_parts")
    shared = parts.where("shared")
    merged = shared.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    merged = common.stored(merged, "trie_shared")
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    merged = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = added_up(merged.select("key", "parent_key", (F.col("n_leaves") + leaf).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    ends = id_digests(shared.where("ends is not null").select("key", F.substring_index("ends", ",", 1).cast("long").alias("first"), "ends"))
    above = common.stored(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")), "trie_above")
    edge = merged.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children").join(sums, "key").join(ends, "key", "left").join(above, "parent_key", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    edge = edge.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    inner = parts.where("not shared").withColumnRenamed("saved", "saved_tokens").withColumnRenamed("ends", "ends_sha256")
    own = inner.where("parent_key is null").select(*columns)
    joined = inner.where("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("above", "parent_conv_id").select(*columns)
    return edge.select(*columns).unionByName(own).unionByName(joined)
