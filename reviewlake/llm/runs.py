"""Periodic runs of words: stretches that repeat with a period three times and more.

Maximal pairs: two places of a text whose words agree for l words, and neither before nor behind. If
the distance p of the two is at most l / 2, the words from the first to the end of the second are one stretch of p + l words with
period p that can't be extended; each run is found so, and nothing has to be extended. Pairs come from the LCP-interval
tree of the suffixes, bottom up. A node holds the places below it in order and which words stand to their left; where two
nodes meet, the pairs are those of neighbouring places with another word to the left. Only neighbours in order can be a run's
smallest period: a place between two would give both a smaller one.

Work: a run of ``least`` words repeats at least 16 words at its period, so only places whose next 16 words come
again in the text can matter. These are found by a rolling hash; what it takes too many changes nothing, as all else is compared exactly.
The stretches around them get a suffix order by doubling and LCPs from its steps, in arrays over many texts at once.
Groups of places that agree for 16 words and have one word to the left can't give a pair and leave before the tree is built.
Rows are independent: no shuffle. A worker holds ``WORDS`` words at a time, or one text.

Defined cases: a null or empty text has no words and no runs; rows that repeat are treated alike; a long text is taken
whole, with about 100 bytes for each word that comes again; other columns pass through, whatever their names; of runs with the same
exponent the first is the strongest, then that of the smaller period.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 24, 3
#: Words that a worker takes at a time.
WORDS = 1_000_000
NO_WORD = -1
ODD = 0x9E3779B97F4A7C15


def _repeated(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Flags of the places whose next width words come again in their text (and of few others, where hashes agree)."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n < width:
        return out
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h, have = x, 1  # hashes of 2, 4, ... words
    while have < width:
        h = h[: len(h) - have] * np.uint64(ODD + 2 * have) + h[have:]
        h = h ^ (h >> np.uint64(31))
        have *= 2
    whole = np.flatnonzero(doc[: len(h)] == doc[have - 1 :])
    h = h[whole] ^ (doc[whole].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out[whole[order[1:][same]]] = out[whole[order[:-1][same]]] = True
    return out


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys, equal ones alike, and how many there are."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    steps = np.r_[False, keys[order][1:] != keys[order][:-1]].cumsum()
    ranks[order] = steps
    return ranks, int(steps[-1]) + 1 if len(keys) else 0


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their suffixes, and the length of what each shares with the one before (0 for the first).

    Symbols are numbers; each suffix ends, at the latest, at a symbol that occurs once.
    """
    n = len(symbols)
    rank, kinds = _dense(symbols)
    levels = [rank.astype(np.int32)]
    width = 1
    while kinds < n:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank, kinds = _dense(rank * (n + 1) + after)
        levels.append(rank.astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b, shared = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < n
        same = inside.copy()
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        shared[same] += 1 << k
    return order, np.r_[0, shared]


def _pairs(places: Sequence[int], shared: Sequence[int], left: Sequence[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, length): period} of one group: places in suffix order, what each shares with the one before, and the words to their left."""
    found: dict[tuple[int, int], int] = {}
    word = dict(zip(places, left, strict=True))
    many = object()  # more than one word to the left

    def meet(a: list, b: list, length: int) -> list:
        if len(a[0]) < len(b[0]):
            a, b = b, a
        large, small = a[0], b[0]
        if a[1] is many or a[1] != b[1]:
            most = length // (times - 1)
            for x in small:
                at = bisect_left(large, x)
                for i, j in ([(large[at - 1], x)] if at else []) + ([(x, large[at])] if at < len(large) else []):
                    if j - i <= most and j - i + length >= least and word[i] != word[j]:
                        key = i, j - i + length
                        found[key] = min(found.get(key, j - i), j - i)
        for x in small:
            insort(large, x)
        return [large, a[1] if a[1] is not many and a[1] == b[1] else many]

    waiting: list[tuple[int, list]] = []
    node = [[places[0]], left[0]]
    for place, length, before in zip(places[1:], shared[1:], left[1:], strict=True):
        while waiting and waiting[-1][0] >= length:
            own, other = waiting.pop()
            node = meet(other, node, own)
        waiting.append((length, node))
        node = [[place], before]
    while waiting:
        own, other = waiting.pop()
        node = meet(other, node, own)
    return found


def found_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the words ids of texts doc, both over all texts one behind the other; starts count over all."""
    if times < 3:
        raise ValueError("a run repeats three times at least")
    # what a run repeats at its period p: at least times - 1 periods, and least - p words
    width = min(max(least - p, (times - 1) * p) for p in range(1, least + 1))
    fit = 1 << (width.bit_length() - 1)  # the hash takes a power of two
    candidates = np.flatnonzero(_repeated(ids, doc, fit))
    if not len(candidates):
        return []
    covered = np.zeros(len(ids) + fit + 1, np.int64)
    np.add.at(covered, candidates, 1)
    np.add.at(covered, candidates + fit, -1)
    kept = np.flatnonzero(covered[: len(ids)].cumsum() > 0)
    # stretches one behind the other, each with a symbol of its own behind it; words of other texts are other symbols
    ends = np.flatnonzero(np.r_[(kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]]), True])
    words, _ = _dense(doc[kept].astype(np.int64) * (int(ids.max()) + 1) + ids[kept])
    at = np.arange(len(kept)) + np.r_[0, np.cumsum(np.bincount(ends, minlength=len(kept)))[:-1]]
    symbols = np.empty(len(kept) + len(ends), np.int64)
    symbols[at] = words
    symbols[at[ends] + 1] = len(kept) + np.arange(len(ends))
    origin = np.full(len(symbols), -1, np.int64)
    origin[at] = kept
    order, shared = suffix_order(symbols)
    place = origin[order]
    before = np.maximum(place - 1, 0)
    left = np.where((place > 0) & (doc[place] == doc[before]), ids[before], NO_WORD)
    # groups that share width words
    starts = np.flatnonzero(shared < width)
    sizes = np.diff(np.r_[starts, len(order)])
    wanted = (np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts)) & (sizes > 1)
    out: list[tuple[int, int, int]] = []
    for a, n in zip(starts[wanted].tolist(), sizes[wanted].tolist(), strict=True):
        group = _pairs(place[a : a + n].tolist(), shared[a : a + n].tolist(), left[a : a + n].tolist(), least, times)
        out += [(start, length, period) for (start, length), period in group.items()]
    return out


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What is known of one text from its runs (start, length, period): their number, the strongest, digests, and the words that stay."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    strongest = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    start, length, period = strongest or (None, None, None)
    listed = hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest()
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            gone[s + p] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, gone.cumsum().tolist()) if not g]
    return len(runs), start, length, period, 1000 * length // period if runs else None, listed, b" ".join(words).decode("utf-8", "replace")


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, runs array<struct<start: long, length: long, period: long>>"

COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "runs"]


def _blocks(texts: list[str | None], words: int) -> Iterator[list[list[bytes]]]:
    """The words of texts, so many at a time, or one text's."""
    block, size = [], 0
    for text in texts:
        split = (text or "").encode("utf-8", "replace").split()
        if block and size + len(split) > words:
            yield block
            block, size = [], 0
        block.append(split)
        size += len(split)
    if block:
        yield block


def results(block: list[list[bytes]], least: int, times: int) -> Iterator[tuple]:
    """``described`` of each text of a block, with its runs."""
    flat = pa.array([w for words in block for w in words], pa.binary()).dictionary_encode()
    sizes = np.array([len(words) for words in block], np.int64)
    ids, doc = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(block)), sizes)
    begins = np.r_[0, sizes.cumsum()]
    own: list[list] = [[] for _ in block]
    for start, length, period in found_runs(ids, doc, least, times):
        i = int(doc[start])
        own[i].append((start - int(begins[i]), length, period))
    for words, runs in zip(block, own, strict=True):
        yield (*described(words, runs), [{"start": s, "length": n, "period": p} for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))])


def found(text: Column, least: int = LEAST, times: int = TIMES, words: int = WORDS) -> Column:
    """Struct of SCHEMA for a column of texts: the runs, and the text that is left when each keeps its first period, words joined by blanks."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in _blocks(batch.tolist(), words):
                yield pd.DataFrame(results(block, least, times), columns=COLUMNS).astype({k: "Int64" for k in COLUMNS[1:5]})

    return F.pandas_udf(run, SCHEMA)(text)


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with each run of its texts cut to one period; texts without runs as they are. All columns and rows stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), found(F.col("text")).alias("_runs"))
    text = F.when(F.col("_runs.n_runs") > 0, F.col("_runs.collapsed")).otherwise(F.col("_row.text"))
    return rows.select(*[(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
