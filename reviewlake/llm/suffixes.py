"""Repeated passages by a sparse suffix array.

A text is its words (A-Z lower-cased). Of each window of ``MIN_WORDS - K + 1`` runs of K
words, those with the least hash are kept, so that any passage of MIN_WORDS words that two
documents share has a kept position in both, chosen by its content alone. The suffixes at
kept positions whose run occurs in another document are sorted by run, then by the words to
the right, then by those to the left; each is compared with its neighbours in that order and
the match extended to both sides. Matches of at least MIN_WORDS words with another
document are reported, those that overlap within a document as one span.

Two suffixes with as many words to the right and others between them are no neighbours, so
comparison alone could miss a match. Where the suffixes of a run differ, each also gives the
hashes of the windows of MIN_WORDS words around its run, and windows that two documents
have are matches as well. Those meet by hash, with partial sums, so any number of documents
may hold one. Together they find all words that brute force over windows of MIN_WORDS finds.

The sort is a range partitioning by the whole suffix and the document, so one very common
run is spread over partitions. A batch of rows is compared by itself: what lies across the edge
of a batch or a partition is found by its windows, so nothing is carried from batch to batch.
Runs and windows are compared by 64-bit hashes, single words beside a run by 32 bits of theirs.

Texts of equal words are one: the least document of such a group is searched, and the others
are spans as a whole.

Defined cases: null and short texts have no spans; rows without doc_id are left out; rows
that share a doc_id are one document, so their copies do not count; a passage that repeats
within one document alone is no match; of several other documents that hold a span the
least that was met is named; texts are taken whole, however long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
K = 31
SIDE = MIN_WORDS - K
#: Bytes of a word's hash beside a run.
WORD = 4
SUFFIX = "anchor long, right binary, left binary, doc_id {id}, pos int"
#: Matches (anchor is null), and windows: of the one document doc_id at pos, or of several from lo to hi.
FOUND = "doc_id {id}, pos int, start int, end int, other_doc {id}, anchor long, l int, w long, lo {id}, hi {id}"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over each run of width values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = fold(out[: len(out) - step], out[step:])
        have += step
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(29)) ^ b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _run_hashes(h: np.ndarray) -> np.ndarray:
    """The hash of each run of K words, from those of its halves."""
    power, have, done, out = h, 1, 0, None
    while True:
        if K & have:
            out = power if out is None else _joined(out[: len(h) - K + 1], power[done : done + len(h) - K + 1])
            done += have
        if done == K:
            return out[: len(h) - K + 1]
        power = _joined(power[:-have], power[have:])
        have *= 2


def kept_positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and the hashes of their runs of K words."""
    n = len(h) - K + 1
    width = MIN_WORDS - K + 1
    if n < width:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    run = _run_hashes(h)
    least = _sliding(run, width, np.minimum)
    # kept: those equal to the least of one of the windows they are in
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == run)
    return at.astype(np.int32), run[at].view(np.int64)


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, n, whole, words, pos, anchor) for each text: words, hash of them all, short word hashes, kept positions, hashes of their runs."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in common.slices(batches):
            rows = []
            for text in texts:
                h = word_hashes(text)
                pos, anchor = kept_positions(h)
                # no word is all zeros, which stand before and behind a text
                words = np.maximum(h >> np.uint64(64 - 8 * WORD), np.uint64(1)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD :].tobytes() if len(pos) else b""
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), words, pos, anchor))
            yield pd.DataFrame(rows, columns=["n", "whole", "words", "pos", "anchor"])

    made = F.pandas_udf(run, "n int, whole binary, words binary, pos array<int>, anchor array<long>")
    found = docs.where("doc_id is not null and text is not null").select("doc_id", made(F.col("text")).alias("s")).select("doc_id", "s.*").where(F.size("pos") > 0)
    return common.stored(found, "suffix_words")


def suffixes(found: DataFrame) -> DataFrame:
    """The suffixes whose run occurs in more than one document."""
    anchors = found.select("doc_id", F.explode(F.arrays_zip("pos", "anchor")).alias("a")).select("doc_id", "a.pos", "a.anchor")
    # stored, so that the join is free to split a hot anchor, which a sum in the same stage would not let it
    shared = common.stored(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "suffix_anchors")
    wanted = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("anchor").alias("anchor"))
    rows = found.select("doc_id", "words").join(wanted, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(SIDE)
        for part in (batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64)):
            for doc_id, words, pos, anchor in zip(part.column("doc_id"), part.column("words"), part.column("pos"), part.column("anchor"), strict=True):
                x = np.frombuffer(words.as_py(), f"V{WORD}")
                x = np.concatenate([np.zeros(SIDE, x.dtype), x, np.zeros(SIDE + K, x.dtype)])
                places = pos.values.to_numpy()
                for at in range(0, len(places), 4096):
                    p = places[at : at + 4096].astype(np.int64) + SIDE
                    right, left = x[(p + K)[:, None] + around], x[(p - 1)[:, None] - around]
                    binary = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIDE * WORD), len(m), [None, pa.py_buffer(m.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([anchor.values.slice(at, len(p)), binary(right), binary(left), pa.array([doc_id.as_py()] * len(p), doc_id.type), pa.array(places[at : at + 4096])], names=["anchor", "right", "left", "doc_id", "pos"])

    return rows.mapInArrow(cut, SUFFIX.format(id=_id_type(found)))


def _words_of(column: pa.Array) -> np.ndarray:
    """rows x SIDE word hashes."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIDE, WORD)
    out = np.zeros((len(data), SIDE), np.uint64)
    for i in range(WORD):
        out = out << np.uint64(8) | data[:, :, i]
    return out


def _lead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of a and b agree from the first on."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), SIDE, (~same).argmax(1)).astype(np.int32)


def _sums(x: np.ndarray, odd: int) -> np.ndarray:
    """Hashes of the first 0 to SIDE words of each row."""
    out = np.zeros((len(x), SIDE + 1), np.uint64)
    for i in range(SIDE):
        h = (out[:, i] ^ x[:, i]) * np.uint64(odd)
        out[:, i + 1] = h ^ (h >> np.uint64(31))
    return out


def _compared(batch: pa.RecordBatch) -> Iterator[dict]:
    """Matches of sorted rows with their neighbours, and the windows of those that differ."""
    n = batch.num_rows
    anchor, pos = batch.column("anchor").to_numpy(), batch.column("pos").to_numpy()
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
    right, left = _words_of(batch.column("right")), _words_of(batch.column("left"))
    new_run = np.r_[True, anchor[1:] != anchor[:-1]]
    new = new_run | np.r_[True, (right[1:] != right[:-1]).any(1) | (left[1:] != left[:-1]).any(1)]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], n] - 1
    which = np.cumsum(new) - 1
    lo, hi = doc[starts], doc[ends]  # equal suffixes are in order of document
    several = lo != hi
    n_left, n_right = (left != 0).sum(1).astype(np.int32), (right != 0).sum(1).astype(np.int32)
    # equal suffixes of several documents match in all their words
    best_l, best_r = np.zeros(n, np.int32), np.zeros(n, np.int32)
    other = lo[which].copy()
    full = several[which]
    best_l[full], best_r[full] = n_left[full], n_right[full]
    mine = other == doc
    other[mine] = hi[which][mine]
    # the others are compared with the rows on both sides
    for step, near in ((-1, starts[which] - 1), (1, ends[which] + 1)):
        at = np.flatnonzero(~full & (near >= 0) & (near < n))
        to = near[at]
        ok = (anchor[at] == anchor[to]) & (doc[at] != doc[to])
        at, to = at[ok], to[ok]
        if len(at):
            l, r = _lead(left[at], left[to]), _lead(right[at], right[to])
            better = l + r > best_l[at] + best_r[at]
            i = at[better]
            best_l[i], best_r[i], other[i] = l[better], r[better], doc[to[better]]
    at = np.flatnonzero(K + best_l + best_r >= MIN_WORDS)
    yield {"doc_id": doc[at], "pos": pos[at], "start": pos[at] - best_l[at], "end": pos[at] + K + best_r[at], "other_doc": other[at]}
    # a run of one suffix alone, which ends within these rows, has no other windows to meet
    run = np.cumsum(new_run) - 1
    kinds = np.bincount(run[starts])
    open_run = (kinds > 1)[run]
    open_run |= (run == 0) | (run == run[-1])
    give = np.flatnonzero(open_run & (~full | new))
    if not len(give):
        return
    ls, rs = _sums(left[give], 0x9E3779B97F4A7C15), _sums(right[give], 0xC2B2AE3D27D4EB4F)
    for l in range(SIDE + 1):
        r = SIDE - l
        ok = np.flatnonzero((n_left[give] >= l) & (n_right[give] >= r))
        if len(ok):
            i = give[ok]
            w = ((ls[ok, l] * np.uint64(0xFF51AFD7ED558CCD)) ^ rs[ok, r]).view(np.int64)
            yield {"doc_id": doc[i], "pos": pos[i], "anchor": anchor[i], "l": np.full(len(i), l, np.int32), "w": w, "lo": lo[which[i]], "hi": hi[which[i]], "none": full[i]}


def _neighbours(id_type: str):
    """A step over sorted suffixes that gives rows of ``FOUND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.schema.field("doc_id").type
            types = {"doc_id": ids, "pos": pa.int32(), "start": pa.int32(), "end": pa.int32(), "other_doc": ids, "anchor": pa.int64(), "l": pa.int32(), "w": pa.int64(), "lo": ids, "hi": ids}
            for part in (batch.slice(at, 16384) for at in range(0, batch.num_rows, 16384)):
                for rows in _compared(part):
                    none, size = rows.pop("none", None), len(rows["doc_id"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(size, t) if rows.get(c) is None else pa.array(rows[c], t, mask=none if c in ("doc_id", "pos") else None) for c, t in types.items()], names=list(types)
                    )

    return run


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, other_doc): word spans that another document has too, for each kept position and each copy as a whole."""
    order = ["anchor", "right", "left", "doc_id", "pos"]
    texts = sequences(docs)
    # stored, so that the join is free to split a large group of copies
    groups = texts.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = common.stored(texts.select("doc_id", "n", "whole").join(common.stored(groups, "suffix_copies"), "whole").select("doc_id", "n", "least", "most"), "suffix_whole")
    later = copies.where("doc_id <> least").select("doc_id").distinct()
    rows = common.stored(suffixes(texts.join(later, "doc_id", "left_anti").select("doc_id", "words", "pos", "anchor")), "suffixes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ids = _id_type(docs)
    found = common.stored(ordered.mapInArrow(_neighbours(ids), FOUND.format(id=ids)), "suffix_matches")
    windows = found.where("anchor is not null").select("anchor", "l", "w", "doc_id", "pos", "lo", "hi")
    held = windows.groupBy("anchor", "l", "w").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most")
    held = common.stored(held, "suffix_windows")
    of_one = windows.where("doc_id is not null").select("anchor", "l", "w", "doc_id", "pos").join(held, ["anchor", "l", "w"])
    by_window = of_one.select("doc_id", "pos", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") - F.col("l") + MIN_WORDS).alias("end"), F.when(F.col("least") == F.col("doc_id"), F.col("most")).otherwise(F.col("least")).alias("other_doc"))
    both = found.where("anchor is null").select("doc_id", "pos", "start", "end", "other_doc").unionByName(by_window)
    # all matches at one kept position hold its run, so they are one
    one = both.groupBy("doc_id", "pos").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_doc").alias("other_doc")).drop("pos")
    whole = copies.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.when(F.col("least") == F.col("doc_id"), F.col("most")).otherwise(F.col("least")).alias("other_doc"))
    return one.unionByName(whole)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, other_doc): matches that overlap are one span; words are counted from 0, end is outside."""
    own = Window.partitionBy("doc_id").orderBy("start", "end", "other_doc")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    found = matches(docs).distinct()
    marked = found.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_doc").alias("other_doc"))
    return merged.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other_doc")
