"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums bucket counts by language over all training documents; the matrix of log
probabilities (languages x buckets) is broadcast, and batches are scored by gathering its
rows at the n-grams' buckets and summing over each document.

Every language with a training text is learned, however rare it is. The matrix has at most ``CELLS``
cells: with more than CELLS / BUCKETS languages it has fewer buckets for each, and more than
``MAX_LANGS`` labels are an error of the column and end the job.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every
text if nothing could be learned; rows without lang do not train; repeated rows train and are
predicted each; ties go to the first language in order of name; a long text is scored
whole, in blocks of n-grams; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
ALPHA = 0.5
CELLS = 1 << 22
MAX_LANGS = 4096
#: Characters that are cut into n-grams at once, and n-grams times languages that are scored at once.
PIECE, BLOCK = 1 << 18, 1_600_000


def _letters() -> np.ndarray:
    """Lower-case letter for each of the first 65,536 code points; what is no letter is a space."""
    table = np.full(65536, 32, np.uint32)
    for code in range(65536):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


LETTERS = _letters()


def bucket_blocks(text: str, n_buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the letters, in blocks; nothing if there is no letter. What is no letter counts as one space, as do both ends."""
    carry, letters, waiting = np.zeros(0, np.uint64), False, []
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max() >= 65536:
            codes = np.where(codes < 65536, LETTERS[np.minimum(codes, 65535)], np.array([ord(c) if c.isalpha() else 32 for c in piece], np.uint32))
        else:
            codes = LETTERS[codes]
        first, last = at == 0, at + PIECE >= len(text)
        codes = np.concatenate([[32] if first else carry[-1:], codes, [32] if last else []]).astype(np.uint64)
        # runs of what is no letter count as one space
        space = codes == 32
        codes = codes[np.r_[True, ~(space[1:] & space[:-1])]]
        letters |= bool((codes != 32).any())
        held = len(carry)
        codes = np.concatenate([carry[:-1], codes])
        out, h = [], None
        for n in range(1, max(ORDERS) + 1):
            h = codes + np.uint64(1) if h is None else h[: max(0, len(codes) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                new = h[max(0, held - n + 1) :]  # those that end in this piece
                mixed = (new ^ (new >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed >> np.uint64(64 - (n_buckets.bit_length() - 1))).astype(np.int64))
        carry = codes[-(max(ORDERS) - 1) :]
        waiting.append(np.concatenate(out))
        if letters:
            yield from waiting
            waiting = []


def buckets(text: str, n_buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of the letters; empty if there is no letter."""
    return np.concatenate([np.zeros(0, np.int64), *bucket_blocks(text, n_buckets)])


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages
    prior: np.ndarray


def train(docs: DataFrame) -> Model:
    """From text and lang alone, over all rows of docs that have both."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    rows = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    langs = [r.lang for r in rows]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    size = BUCKETS
    while size * len(langs) > CELLS:
        size //= 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang").text:
                mine = sums.setdefault(lang, np.zeros(size, np.int64))
                parts, n = [], 0
                for found in chain.from_iterable(bucket_blocks(t, size) for t in texts):
                    parts.append(found)
                    n += len(found)
                    if n > PIECE:
                        mine += np.bincount(np.concatenate(parts), minlength=size)
                        parts, n = [], 0
                if parts:
                    mine += np.bincount(np.concatenate(parts), minlength=size)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": mine[at]})

    counts = known.mapInPandas(count, "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    table = np.full((len(langs), size), ALPHA)
    table[found.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int), found.bucket.to_numpy(int)] += found.n.to_numpy()
    log_p = np.log(table / table.sum(1, keepdims=True)).T
    sizes = np.array([r["count"] for r in rows], float)
    return Model(langs, np.ascontiguousarray(log_p, np.float32), np.log(sizes / sizes.sum()))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Most probable language of each text and its posterior."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return langs, scores
    block = max(1, BLOCK // len(model.langs))
    sums: dict[int, np.ndarray] = {}
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> None:
        starts = np.cumsum([0, *map(len, parts[:-1])])
        for row, x in zip(rows, np.add.reduceat(model.log_p[np.concatenate(parts)], starts, axis=0, dtype=np.float64), strict=True):
            sums[row] = sums[row] + x if row in sums else x + model.prior
        rows.clear()
        parts.clear()

    size = 0
    for i, text in enumerate(texts):
        for found in bucket_blocks(text or "", len(model.log_p)):
            for at in range(0, len(found), block):
                rows.append(i)
                parts.append(found[at : at + block])
                size += len(parts[-1])
                if size >= block:
                    flush()
                    size = 0
    if rows:
        flush()
    for i, x in sums.items():
        best = int(x.argmax())
        langs[i], scores[i] = model.langs[best], float(1 / np.exp(x - x[best]).sum())
    return langs, scores


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs as ``_row`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = score(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return common.packed(docs, _l=F.pandas_udf(run, "lang_pred string, score double")(F.col("text"))).select("_row", "_l.*")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
