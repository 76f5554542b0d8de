"""Language-model scores from a class-based bigram model (Brown classes).

    p(w | v) = mix * p(class w | class v) * p(w | class w) + (1 - mix) * (c + 1) / (N + V + 1)

Counts c, N and V are over all training tokens; a token is a word (A-Z lower-cased) or the
end of a document, and the end is also what stands before a first word. Classes:

* every word seen ``min_count`` times in training gets its class by exchange: in each sweep, half
  of these words may move to the class that most raises the likelihood of the class bigrams,
  given what stands left and right of each word in all training text. Sweeps end when few
  words move, when one gains little of what all have gained, or when the likelihood falls, and the best classes stay;
* every other word, known or not, has the class of its shape (ending, digits, script,
  length), which needs no list of words;
* the end has a class of its own.

Within a class of shapes a word has (c + 1) / (C + V + 1), with C and V of that class; the
rest is for words never seen. So probabilities sum to one, as with the base score.

Work: words are counted by one shuffle. The clustered ones grow with the corpus; they are broadcast
as 64-bit hashes with counts and classes, 20 bytes each, up to ``most`` words (80 MB), from
where on only more frequent ones are clustered. Training text is stored once as symbol ids; a
sweep sums what stands beside each word in sparse blocks of words, which meet by block in two
steps, and moves a block's words where its sums are. Scoring is one pass over the texts;
tokens that are not clustered are joined with the full counts, and then summed by row.

Defined cases: a null or empty text is the end alone; with no training tokens every
probability is that of a model with all counts 0; repeated rows are scored each; a row
without doc_id is scored and not held out; a word that fits two classes alike takes the first;
other columns of docs are not read; a long text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The end token; no word has a space.
END = " end"
SHAPES = 24
#: Texts of ids that a worker takes at a time, whatever the size of the batches that reach it.
ROWS = 256
#: Bytes of text that it splits at a time: a word that comes again in them is looked up once.
PART = 4_000_000

#: Cells that a task holds before it sums them up, at 4 bytes each.
CELLS = 12_000_000


@dataclass(frozen=True)
class Params:
    classes: int = 32
    min_count: int = 5
    most: int = 4_000_000
    #: Half-sweeps at most. They end before, when fewer than ``least_moved`` of the words that may move do, or one gains less than ``least_gain`` of what all have gained.
    sweeps: int = 24
    least_moved: float = 0.01
    least_gain: float = 0.1
    mix: float = 0.9
    smooth: float = 0.05
    #: Words in a block of sums; with two sides of at most 64 classes its cells have 16-bit numbers.
    block: int = 512


DIGIT = re.compile(rb"[0-9]")
#: Kinds of bytes.
ALPHA, DIGITS, AT, ASCII = (np.array([test(bytes([i])) for i in range(256)]) for test in (bytes.isalpha, bytes.isdigit, b"@".__eq__, bytes.isascii))


def shape(w: bytes) -> int:
    """Class of a word by its form: 0 to SHAPES - 1."""
    if DIGIT.search(w):
        return 0 if b"@" in w else 1 if w.isdigit() else 2
    if w.isascii():
        if w.isalpha():
            return 3 + min(len(w) - 1, 23) // 3  # 3 to 10
        last = w[-1:]
        return 11 if last == b"." else 12 if last == b"," else 13 if last in b"!?;:" else 14 if w[:-1].isalpha() else 15 if w[:1].isalpha() else 16
    last = w[-1:]
    return 17 if last == b"." else 18 if last == b"," else 19 + min(len(w) - 1, 24) // 6


def shapes(words: pa.Array) -> np.ndarray:
    """``shape`` of each word, by counts of its bytes of a kind."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    if not len(data):
        return np.full(len(words), shape(b""))
    a, b = off[:-1], off[1:]

    def count(of: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(of[data], dtype=np.int64)]
        return sums[b] - sums[a]

    size, alpha, digits, last = b - a, count(ALPHA), count(DIGITS), data[b - 1]
    wide = count(ASCII) < size
    return np.select(
        [(digits > 0) & (count(AT) > 0), (digits > 0) & (digits == size), digits > 0, wide & (last == ord(".")), wide & (last == ord(",")), wide]
        + [(size > 0) & (alpha == size), last == ord("."), last == ord(","), np.isin(last, list(b"!?;:")), (size > 1) & (alpha - ALPHA[last] == size - 1), ALPHA[data[np.minimum(a, len(data) - 1)]]],
        [0, 1, 2, 17, 18, 19 + np.minimum(size - 1, 24) // 6, 3 + np.minimum(size - 1, 23) // 3, 11, 12, 13, 14, 15],
        16,
    )


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts, one after the other: each token's place among the distinct words, those words, and where each text's end stands. An end has the place -1."""
    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(lowered)
    flat = split.flatten().dictionary_encode()
    words, at = flat.dictionary, flat.indices.to_numpy()
    empty = pc.equal(lowered, "").to_numpy(zero_copy_only=False)  # such a text is split to one empty word
    n_words = pc.list_value_length(split).to_numpy().astype(np.int64) - empty
    if empty.any():
        at = at[at != pc.index(words, pa.scalar("", words.type)).as_py()]
    ends = np.cumsum(n_words + 1) - 1
    out = np.full(len(at) + len(texts), -1, np.int64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = at
    return out, words, ends


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


@dataclass
class Model:
    params: Params
    hashes: np.ndarray  # of the clustered words, ascending
    counts: np.ndarray  # of the clustered words
    end_count: int
    n: int  # training tokens
    v: int  # distinct ones
    classes: np.ndarray  # class of each clustered word
    shape_c: np.ndarray  # tokens by shape, among words that are not clustered
    shape_v: np.ndarray  # distinct words by shape
    table: np.ndarray  # class bigrams; rows: class before
    known: DataFrame  # w, n: all words

    @property
    def covered(self) -> float:
        """Share of the training words' tokens that are of clustered words."""
        return float(self.counts.sum() / max(1, self.n - self.end_count))

    @property
    def end(self) -> int:
        return self.params.classes + SHAPES

    @property
    def emit_c(self) -> np.ndarray:
        """Tokens by class."""
        heads = np.bincount(self.classes, self.counts, self.params.classes) if len(self.classes) else np.zeros(self.params.classes)
        return np.r_[heads, self.shape_c, self.end_count]

    def log_transition(self) -> np.ndarray:
        """log10 p(class | class before)."""
        t = self.table + self.params.smooth * (1 + self.emit_c / max(1, self.n))
        return np.log10(t / t.sum(1, keepdims=True))


def count_words(train: DataFrame) -> DataFrame:
    """(w, n) over all words of the training texts."""
    lowered = common.ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return train.select(F.explode(F.split(lowered, f"[{common.SPACE}]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


def threshold(known: DataFrame, params: Params) -> int:
    """The least count of a clustered word: min_count, or more where more than ``most`` words have that."""
    step = F.floor(F.log(F.col("n").cast("double")) * 50).cast("int")
    sizes = known.where(F.col("n") >= params.min_count).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.step):
        total += r.words
        if total > params.most:
            return least or r.n + 1
        least = r.n
    return params.min_count


class Lookup:
    """Places of words in a sorted array of hashes; -1 for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def of(self, words: Iterable[bytes]) -> dict[bytes, int]:
        distinct = list(set(words))
        return dict(zip(distinct, self.places(distinct).tolist(), strict=True))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts: what follows a part's first text has less than PART bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        part = np.cumsum(sizes) // PART
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def _shape_sums(rest: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words by shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            at = np.fromiter((shape(w.encode()) for w in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            c += np.bincount(at, batch.column(1).to_numpy(), SHAPES).astype(np.int64)
            v += np.bincount(at, minlength=SHAPES)
        yield pa.RecordBatch.from_pydict({"shape": pa.array(range(SHAPES), pa.int32()), "c": pa.array(c), "v": pa.array(v)})

    sums = rest.select("w", "n").mapInArrow(run, "shape int, c long, v long").groupBy("shape").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).toPandas()
    c, v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    c[sums["shape"]], v[sums["shape"]] = sums.c, sums.v
    return c, v


def _symbols(train: DataFrame, shared: Broadcast) -> DataFrame:
    """Each training text as ids: clustered words by their place, then shapes, then the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        n = len(shared.value)
        for part in slices(batches):
            at, words, ends = tokens(part.column("text"))
            place = lookup.places(words.cast(pa.binary()).to_numpy(zero_copy_only=False))
            ids = np.r_[np.where(place >= 0, place, n + shapes(words)), n + SHAPES].astype("<i4")[at]  # -1, an end, is the last
            offsets = np.r_[0, ends + 1].astype(np.int32) * 4
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])], ["ids"])

    return common.stored(train.select("text").mapInArrow(run, "ids binary"), "lm_symbols")


def _packed(cells: np.ndarray, sums: np.ndarray) -> tuple[bytes, bytes]:
    """Cells and their sums in 16 bits; larger sums take more than one entry."""
    while (sums > 65_535).any():
        big = sums > 65_535
        cells, sums = np.r_[cells, cells[big]], np.r_[np.where(big, 65_535, sums), sums[big] - 65_535]
    return cells.astype("<u2").tobytes(), sums.astype("<u2").tobytes()


def _unpacked(group: pa.Table, size: int) -> np.ndarray:
    cells, sums = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<u2") for c in ("cells", "sums"))
    return np.bincount(cells, sums, size)


def _neighbour_sums(symbols: DataFrame, n_words: int, classes: np.ndarray, k: int, block: int, free: int) -> tuple[np.ndarray, DataFrame, str]:
    """The class table (k x k), rows (at, salt, cells, sums) and their place: for each block of clustered words, the classes left and right of those whose place is odd or even as free."""
    shared = symbols.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        return every, np.bincount(where, np.concatenate(sums), len(every)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value.astype(np.int64)
        table = np.zeros(k * k, np.int64)
        done: tuple[list, list] = ([], [])
        none = np.zeros(0, np.int32 if n_words * 2 * k < 2**31 else np.int64)
        waiting, size = [none], 0
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            data = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i4").astype(np.int64)
            c = cls[data]
            before = np.r_[c[-1], c[:-1]]  # each text ends with the end, which also stands before the next one
            after = np.r_[c[1:], c[0]]
            table += np.bincount(before * k + c, minlength=k * k)
            mine = (data < n_words) & (data % 2 == free)
            w = data[mine] * (2 * k)
            waiting += [(w + before[mine]).astype(none.dtype), (w + k + after[mine]).astype(none.dtype)]
            size += 2 * len(w)
            if size > CELLS:
                keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
                done[0].append(keys)
                done[1].append(counts)
                waiting, size = [none], 0
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        if done[0]:
            keys, counts = summed([*done[0], keys], [*done[1], counts])
        keys = keys.astype(np.int64)
        rows = {"at": [-1], "cells": [b""], "sums": [table.tobytes()]}
        blocks = keys // (block * 2 * k)
        edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]) if len(keys) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cells, sums = _packed(keys[a:b] - blocks[a] * (block * 2 * k), counts[a:b])
            rows["at"].append(int(blocks[a]))
            rows["cells"].append(cells)
            rows["sums"].append(sums)
        yield pa.RecordBatch.from_pydict({"at": pa.array(rows["at"], pa.int32()), "cells": pa.array(rows["cells"], pa.binary()), "sums": pa.array(rows["sums"], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        if group.column("at")[0].as_py() < 0:
            cells, sums = b"", sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("sums")).tobytes()
        else:
            out = _unpacked(group, block * 2 * k)
            at = np.flatnonzero(out)
            cells, sums = _packed(at, out[at].astype(np.int64))
        return pa.table({"at": group.column("at").slice(0, 1).combine_chunks(), "salt": group.column("salt").slice(0, 1).combine_chunks(), "cells": pa.array([cells], pa.binary()), "sums": pa.array([sums], pa.binary())})

    # two steps, each of about the square root of the tasks, so that the partial sums of many tasks never meet in one
    salts = max(16, math.isqrt(symbols.rdd.getNumPartitions()))
    partial = symbols.mapInArrow(run, "at int, cells binary, sums binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    once, path = common.stored_at(partial.groupBy("at", "salt").applyInArrow(lambda t: total(t), "at int, salt int, cells binary, sums binary"), "lm_sums")
    table = sum((np.frombuffer(r.sums, np.int64) for r in once.where("at < 0").collect()), np.zeros(k * k, np.int64))
    return table.reshape(k, k), once.where("at >= 0"), path


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, but for what no move changes."""
    xlogx = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return xlogx(table) - xlogx(table.sum(0)) - xlogx(table.sum(1))


def _moved(classes: np.ndarray, table: np.ndarray, sums: DataFrame, n_classes: int, block: int, free: int) -> np.ndarray:
    """Half a sweep of exchange: each free word goes to the class where its neighbours are most probable. Blocks move where their sums are."""
    k = len(table)
    t = table + 0.1
    by_left = np.log(t) - np.log(t.sum(1, keepdims=True)) - np.log(t.sum(0, keepdims=True)) + np.log(t.sum())

    def best(group: pa.Table) -> pa.Table:
        cells = _unpacked(group, block * 2 * k).reshape(block, 2, k)
        gain = cells[:, 0] @ by_left[:, :n_classes] + cells[:, 1] @ by_left[:n_classes, :].T
        chosen = np.where(cells.any((1, 2)), gain.argmax(1), 255).astype(np.uint8)
        return pa.table({"at": group.column("at").slice(0, 1).combine_chunks(), "best": pa.array([chosen.tobytes()], pa.binary())})

    out = np.r_[classes, np.zeros(-len(classes) % block, classes.dtype)]
    for r in sums.groupBy("at").applyInArrow(lambda g: best(g), "at int, best binary").toLocalIterator():
        chosen = np.frombuffer(r.best, np.uint8)
        mine = np.flatnonzero((chosen != 255) & (np.arange(block) % 2 == free)) + r.at * block
        out[mine] = chosen[mine - r.at * block]
    return out[: len(classes)]


def train(docs: DataFrame, params: Params = Params()) -> Model:
    """From the texts of docs alone."""
    known = common.stored(count_words(docs), "lm_counts")
    sums = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.count()
    least = threshold(known, params)
    # as Arrow columns: rows as objects would take the driver fifty times the room
    top = known.where(F.col("n") >= least).select(F.xxhash64("w").alias("h"), "n").toArrow()
    hashes, counts = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    k = params.classes + SHAPES + 1
    # at first, words go round the classes in order of frequency
    classes = np.empty(len(hashes), np.int64)
    classes[np.lexsort((hashes, -counts))] = np.arange(len(hashes)) % params.classes
    fixed = np.arange(params.classes, k)
    symbols = _symbols(docs, docs.sparkSession.sparkContext.broadcast(hashes))
    kept, kept_table, path, gained = classes, None, None, []
    for sweep in range(params.sweeps + 1):
        if path:
            common.remove(docs.sparkSession, path)
        table, beside, path = _neighbour_sums(symbols, len(hashes), np.r_[classes, fixed], k, params.block, sweep % 2)
        gained.append(likelihood(table))
        if sweep and gained[-1] <= gained[-2]:
            break
        kept, kept_table = classes, table
        if sweep > 1 and gained[-1] - gained[-2] < params.least_gain * (gained[-1] - gained[0]):
            break
        if sweep == params.sweeps or not len(hashes):
            break
        classes = _moved(classes, table, beside, params.classes, params.block, sweep % 2)
        if (classes != kept).sum() <= params.least_moved * len(hashes) / 2:
            break
    shape_c, shape_v = _shape_sums(known.where(F.col("n") < least))
    return Model(params, hashes, counts, ends, int(sums[0]) + ends, int(sums[1]) + (ends > 0), kept, shape_c, shape_v, kept_table, known)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, train_tokens) for each row of docs."""
    p, sc = model.params, docs.sparkSession.sparkContext
    trans, emit_c = model.log_transition(), model.emit_c
    kept = {"hashes": model.hashes, "counts": model.counts, "classes": model.classes, "trans": trans, "emit": emit_c, "shape_v": model.shape_v}
    shared, n, v, end, ends = sc.broadcast(kept), model.n, model.v, model.end, model.end_count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup, n_words = Lookup(m["hashes"]), len(m["hashes"])
        cls = np.r_[m["classes"], end].astype(np.int64)
        count = np.r_[m["counts"], ends].astype(float)
        base = (count + 1) / (n + v + 1)
        # within a clustered class all words are known; those of shapes leave room for one that is not
        emit = np.maximum(count, 1) / np.maximum(m["emit"][cls], 1)
        base_log, table = np.log10(base), 10 ** m["trans"]
        z_shape = m["emit"][p.classes : p.classes + SHAPES] + m["shape_v"] + 1
        for part in slices(batches):
            at, words, last = tokens(part.column("text"))
            place = lookup.places(words.cast(pa.binary()).to_numpy(zero_copy_only=False))
            first = np.r_[0, last[:-1] + 1]
            x = np.r_[place, n_words][at]  # -1, an end, is the last
            c = np.where(x >= 0, cls[x], p.classes + np.r_[shapes(words), 0][at])
            step = table[np.r_[end, c[:-1]], c]  # each text ends with the end, which also stands before the next one
            known, rest = x >= 0, np.flatnonzero(x < 0)
            value = np.where(known, np.log10(p.mix * step * emit[x] + (1 - p.mix) * base[x]), 0.0)
            total = lambda a: np.add.reduceat(a, first)
            rid, doc = part.column("rid"), part.column("doc_id")
            own = np.searchsorted(last, rest)  # the text of each unlisted word
            none = lambda t: pa.nulls(len(rest), t)
            # a row of sums for each text, under a key of its own, which is no word, and a row for each unlisted word
            out = {
                "rid": (rid, rid.take(pa.array(own))),
                "doc_id": (doc, doc.take(pa.array(own))),
                "n_tokens": (pa.array(last - first + 1), none(pa.int64())),
                "n_known": (pa.array(total((known & (count[x] > 0)).astype(np.int64))), none(pa.int64())),
                "base": (pa.array(total(np.where(known, base_log[x], 0.0))), none(pa.float64())),
                "score": (pa.array(total(value)), none(pa.float64())),
                "w": (pc.binary_join_element_wise("", rid.cast(pa.string()), " "), words.take(pa.array(at[rest])).cast(pa.string())),
                "weight": (pa.nulls(len(last), pa.float64()), pa.array(p.mix * step[rest] / z_shape[c[rest] - p.classes])),
            }
            yield pa.RecordBatch.from_pydict({name: pa.concat_arrays(pair) for name, pair in out.items()})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    spread = rows.mapInArrow(run, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base double, score double, w string, weight double")
    joined = spread.join(model.known, "w", "left")
    c = F.coalesce("n", F.lit(0))
    unigram = (c + 1) / F.lit(float(n + v + 1))
    unlisted = F.col("weight").isNotNull()
    per_row = joined.groupBy("rid", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(unlisted & F.col("n").isNotNull(), 1).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(unlisted, F.log10(unigram)).otherwise(0.0))).alias("base_score"),
        (F.sum("score") + F.sum(F.when(unlisted, F.log10(F.col("weight") * (c + 1) + (1 - p.mix) * unigram)).otherwise(0.0))).alias("score"),
    )
    return per_row.drop("rid").withColumn("train_tokens", F.lit(n).cast("long"))
