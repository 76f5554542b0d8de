"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are
compared with references of each language by Jensen-Shannon distance (base 2, the
root of the divergence, 0 to 1). The references are sums over all labelled documents.
A document is kept if some language is near in both, and the base rules hold.

Guards: texts under ``min_chars`` characters are not judged by character classes, texts
under ``min_words`` words not by common words; without any reference (no labelled text)
nothing is judged by distance. A null or empty text has no words, so base_failed is true.
Every language with a labelled text has a reference, however rare it is, so that no clean document
is judged by other languages alone; more than ``max_langs`` labels are an error of the
column and end the job. Words that are as frequent are ranked by name. The language of a document
is not used to judge it. Repeated rows are judged alike, one by one; texts are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
VOWELS = "aeiou"
WINDOW = 5
CLASSES = ("vowel", "consonant", "upper", "other_letter", "digit", "space", "newline", "stop", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words_base: int = 10
    max_repeat_percent: int = 20
    common_words: int = 64
    max_langs: int = 4096
    min_chars: int = 200
    max_chars_distance: float = 0.33
    min_words: int = 40
    max_words_distance: float = 0.46


@dataclass
class References:
    langs: list[str]
    words: list[dict[str, int]] = field(default_factory=list)
    word_p: list[np.ndarray] = field(default_factory=list)
    chars_p: list[np.ndarray] = field(default_factory=list)


def _class_table() -> np.ndarray:
    """The class of each of the first 65,536 code points; beyond them all is 'other'."""
    at = {name: i for i, name in enumerate(CLASSES)}
    table = np.full(65536, at["other"], np.uint8)
    for code in range(65536):
        c = chr(code)
        if "a" <= c <= "z":
            table[code] = at["vowel"] if c in VOWELS else at["consonant"]
        elif c == "\n":
            table[code] = at["newline"]
        elif c.isspace():
            table[code] = at["space"]
        elif c.isupper():
            table[code] = at["upper"]
        elif c.isalpha():
            table[code] = at["other_letter"]
        elif c.isdigit():
            table[code] = at["digit"]
        elif c in ".,;:'\"?!-()":
            table[code] = at["stop"]
        elif c in SYMBOLS:
            table[code] = at["symbol"]
    return table


CLASS_OF = _class_table()


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.bincount(CLASS_OF[codes[codes < 65536]], minlength=len(CLASSES))
    found[len(CLASSES) - 1] += int((codes >= 65536).sum())
    return found


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p (or p itself) and each row of q."""
    p, q = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(0.0, both.sum(-1) / 2))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of equal length."""
    return float(distances(p, q[None])[0])


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, words in repeated windows."""
    words = WORDS.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    dup_lines = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            lines = [x for x in lines if WORDS.search(x)]
            dup_lines = len(lines) - len(set(lines))
    n, repeat = len(words), 0
    if n > WINDOW:
        ids: dict[str, int] = {}
        x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        if len(ids) < n:
            repeat = _repeated(x, len(ids))
    return words, sum(map(len, words)), symbols, dup_lines, repeat


def _repeated(x: np.ndarray, n_ids: int) -> int:
    """Words inside windows that occur twice or more; windows are compared exactly, by ranks of ever longer runs."""
    rank = x
    for k in range(1, WINDOW):
        pairs = rank[:-1] * np.int64(n_ids + 1) + x[k:]
        distinct, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
    again = count[rank] > 1
    edge = np.zeros(len(x) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """Sums over all documents with text and lang; one bounded row for each language comes to the driver."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    langs = [r.lang for r in known.select("lang").distinct().orderBy("lang").limit(rules.max_langs + 1).collect()]
    if len(langs) > rules.max_langs:
        raise ValueError(f"more than {rules.max_langs} languages")
    refs = References(langs)
    if not langs:
        return refs

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, i, int(n)) for lang, texts in batch.groupby("lang").text for i, n in enumerate(sum(map(class_counts, texts)))]
            yield pd.DataFrame(rows, columns=["lang", "cls", "n"])

    chars = known.mapInPandas(classes, "lang string, cls int, n long").groupBy("lang", "cls").agg(F.sum("n").alias("n"))
    words = known.select("lang", F.explode(F.split("text", f"[{common.SPACE}]+")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    # two steps of ranking: a language's words are first ranked within 64 parts
    order = [F.desc("n"), "w"]
    part = Window.partitionBy("lang", "part")
    parts = words.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64))).withColumns({"r": F.row_number().over(part.orderBy(*order)), "part_n": F.sum("n").over(part)})
    best = parts.where(F.col("r") <= rules.common_words).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    found = best.where((F.col("rank") <= rules.common_words) | (F.col("r") == 1)).drop("part").toPandas()
    sums = chars.toPandas()
    for lang in langs:
        mine = found[found.lang == lang]
        top = mine[mine["rank"] <= rules.common_words].sort_values("rank")
        rest = int(mine[mine.r == 1].part_n.sum() - top.n.sum())
        refs.words.append({w: i for i, w in enumerate(top.w)})
        refs.word_p.append(np.r_[top.n.to_numpy(float), rest])
        hist = np.zeros(len(CLASSES))
        for cls, n in sums[sums.lang == lang][["cls", "n"]].itertuples(index=False):
            hist[cls] = n
        refs.chars_p.append(hist)
    return refs


def word_histogram(words: list[str], common_words: dict[str, int]) -> np.ndarray:
    hist = np.zeros(len(common_words) + 1)
    get, rest = common_words.get, len(common_words)
    at = np.fromiter((get(w, rest) for w in words), np.int64, len(words))
    return hist + np.bincount(at, minlength=rest + 1)


def judged(docs: DataFrame, refs: References, rules: Rules = Rules()) -> DataFrame:
    """docs as ``_row`` with the base counts, the two distances to the nearest language, and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        refs = shared.value
        every: dict[str, int] = {}
        for d in refs.words:
            for w in d:
                every.setdefault(w, len(every))
        # columns of the joint histogram for each language's own words; the last one, always 0, fills up
        most, zero = max(map(len, refs.words), default=0), len(every) + 1
        columns = np.array([[every[w] for w in d] + [zero] * (most - len(d)) for d in refs.words], np.int64).reshape(len(refs.words), most)
        chars_q = np.array(refs.chars_p).reshape(-1, len(CLASSES))
        words_q = np.array([np.r_[p[:-1], np.zeros(most + 1 - len(p)), p[-1]] for p in refs.word_p]).reshape(-1, most + 1)
        for texts in common.slices(batches):
            rows = []
            for text in texts:
                text = text or ""
                words, word_chars, symbols, dup_lines, repeat = base_counts(text)
                failed = len(words) < rules.min_words_base or 100 * repeat > rules.max_repeat_percent * len(words)
                by_chars = by_words = None
                if refs.langs and len(text) >= rules.min_chars:
                    by_chars = float(distances(class_counts(text), chars_q).min())
                if refs.langs and len(words) >= rules.min_words:
                    own = np.r_[word_histogram(words, every), 0][columns]
                    by_words = float(distances(np.c_[own, len(words) - own.sum(1)], words_q).min())
                near = (by_chars is None or by_chars <= rules.max_chars_distance) and (by_words is None or by_words <= rules.max_words_distance)
                rows.append((len(words), word_chars, symbols, dup_lines, repeat, failed, by_chars, by_words, near and not failed))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "kept"])

    measured = F.pandas_udf(measure, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_distance double, words_distance double, kept boolean")
    return common.packed(docs, _q=measured(F.col("text"))).select("_row", "_q.*")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep; same columns."""
    return common.replaced(judged(docs, references(docs, rules), rules).where("kept"), docs)
