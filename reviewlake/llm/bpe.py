"""BPE encoding and decoding by a contiguous array of ranks.

The vocabulary is a tokenizers JSON file of the kind "BPE with word ends": NFC, white
space to one space, lower case, split by a pattern, bytes as letters, and an end-of-word
suffix. The driver reads the file (its size is fixed) and broadcasts it; documents are
encoded where they lie, without a shuffle.

Each short word is a row of part ids (a boundary before each) and a row of ranks of
adjacent parts. The least rank is sought by a scan, of equal ones the first; its boundary goes,
and the ranks on both sides are looked up again. The distinct words of some texts that a worker
doesn't remember are taken through this together, as matrices of like length. Words of more than
``LONG`` bytes, where scans would cost the square of the length, use the same order of
merges through a heap.

Defined cases: a null text is empty and has no tokens; the strings of special tokens in a
text are those tokens, as the library has it; repeated rows are encoded each; a long text is
encoded in pieces between words.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LONG = 64
NONE = 1 << 60
#: Chunks of text that a worker remembers, in each of two generations.
REMEMBERED = 50_000
#: Characters that are encoded at a time, about.
PIECE = 1 << 20
#: Words go through the merges with others of at most so many bytes.
WIDTHS = (4, 6, 8, 10, 13, 17, 24, 36, LONG)
WIDTH_OF = [next(w for w in WIDTHS if w >= n) for n in range(LONG + 1)]
#: Unicode's white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.compile(f"[{SPACES}]+")

# Letters and numbers of Unicode 16 and lower-case pairs of 16 and 17, which the interpreter's data may be too old for.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


@cache
def category_ranges(major: str) -> str:
    """All code points of a general category (L or N), as the inside of a character class."""
    out, start, last = [], None, None
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] == major:
            start, last = (code if last != code - 1 else start), code
        elif last == code - 1 and start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
    later = LATER_LETTERS if major == "L" else LATER_NUMBERS
    return "".join(out) + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in later)


def split_pattern(pattern: str) -> re.Pattern:
    """A tokenizer's split pattern with its properties written out."""
    for name, inside in ((r"\p{L}", category_ranges("L")), (r"\p{N}", category_ranges("N")), (r"\s", SPACES)):
        pattern = pattern.replace(name, inside)
    return re.compile(pattern)


LATER = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")


def byte_letters() -> list[str]:
    """The letter for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]
    first: list[int]  # id of each byte inside a word
    last: list[int]  # id of each byte at a word's end
    ranks: dict[int, int]  # id << 20 | id: rank
    merged: list[int]  # id by rank
    pattern: str
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        ranks, merged = {}, []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a] << 20 | vocab[b]] = r
            merged.append(vocab[a + b])
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        letters = byte_letters()
        return cls(tokens, [vocab[c] for c in letters], [vocab[c + end] for c in letters], ranks, merged, splits[0], special)


class Ranks:
    """Ranks of pairs of ids for whole arrays."""

    def __init__(self, ranks: dict[int, int]):
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(NONE)), np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], NONE)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where a and b don't merge, or one of them is no part (-1)."""
        key = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_short(parts: np.ndarray, ranks: Ranks, merged: np.ndarray) -> np.ndarray:
    """The merged parts of each row of a matrix of part ids; behind a row's last part stands -1."""
    out = np.full_like(parts, -1)
    rows = np.arange(len(parts))
    near = ranks.of(parts[:, :-1], parts[:, 1:])
    while near.shape[1]:
        at = near.argmin(1)
        least = near[np.arange(len(near)), at]
        done = least == NONE
        if done.any():
            out[rows[done], : parts.shape[1]] = parts[done]
            rows, parts, near, at, least = (x[~done] for x in (rows, parts, near, at, least))
        if not len(rows):
            return out
        i = np.arange(len(rows))
        parts[i, at] = merged[least]
        # the boundary goes, and with it the rank across it
        parts = np.take_along_axis(parts, (c := np.arange(parts.shape[1] - 1)) + (c > at[:, None]), 1)
        near = np.take_along_axis(near, (c := np.arange(near.shape[1] - 1)) + (c >= at[:, None]), 1)
        if near.shape[1]:
            right = np.flatnonzero(at < near.shape[1])
            near[right, at[right]] = ranks.of(parts[right, at[right]], parts[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            near[left, at[left] - 1] = ranks.of(parts[left, at[left] - 1], parts[left, at[left]])
    out[rows, : parts.shape[1]] = parts
    return out


def merge_long(parts: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """The same merges in the same order, with neighbours linked and candidates in a heap."""
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] << 20 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = merged[r], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (s := ranks.get(parts[x] << 20 | parts[y])) is not None:
                heapq.heappush(heap, (s, x, parts[x], parts[y]))
    return [p for p in parts if p >= 0]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ranks, self.merged = Ranks(vocabulary.ranks), np.array(vocabulary.merged, np.int64)
        self.first, self.last = np.array(vocabulary.first, np.int64), np.array(vocabulary.last, np.int64)
        self.find = split_pattern(vocabulary.pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.marks = tuple(vocabulary.special)
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each of the distinct words."""
        out, by_width = {}, {w: [] for w in WIDTHS}
        for w in words:
            data = w.encode("utf-8", "replace")
            if len(data) > LONG:
                parts = [self.v.first[b] for b in data]
                parts[-1] = self.v.last[data[-1]]
                out[w] = np.array(merge_long(parts, self.v.ranks, self.v.merged), "<u4").tobytes()
            else:
                by_width[WIDTH_OF[len(data)]].append((w, data))
        for width, some in by_width.items():
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                n = np.array([len(d) for _, d in part])
                data = np.frombuffer(b"".join(d.ljust(width, b"\0") for _, d in part), np.uint8).reshape(-1, width)
                parts = np.where(np.arange(width) < n[:, None], self.first[data], -1)
                i = np.arange(len(part))
                parts[i, n - 1] = self.last[data[i, n - 1]]
                ids = merge_short(parts, self.ranks, self.merged)
                sizes = ((ids >= 0).sum(1) * 4).tolist()
                whole = ids.astype("<u4").tobytes()
                for k, ((w, _), size) in enumerate(zip(part, sizes, strict=True)):
                    out[w] = whole[k * width * 4 : k * width * 4 + size]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of these chunks (runs without a space)."""
        again = chunks & self.old.keys()
        self.chunks.update((c, self.old[c]) for c in again)
        new = list(chunks - again)
        split = list(map(self.find, new))
        known = self.words(list(set(chain.from_iterable(split))))
        self.chunks.update((c, known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws))) for c, ws in zip(new, split, strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def flush() -> None:
            self.learn(set().union(*(x for _, x in waiting if isinstance(x, list))) - self.chunks.keys())
            for i, x in waiting:
                out[i].append(x if isinstance(x, bytes) else b"".join(map(self.chunks.__getitem__, x)))
            waiting.clear()
            if len(self.chunks) > REMEMBERED:
                self.old, self.chunks = {c: x for c, x in self.chunks.items() if len(c) <= LONG}, {}

        for i, text in enumerate(texts):
            for part in self.pieces(text or ""):
                waiting.append((i, part))
                size += len(part)
                if size > PIECE // 4:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """The text as lists of chunks, and the ids of special tokens between them."""
        special = self.cut is not None and any(m in text for m in self.marks)
        for part in self.cut(text) if special else [text]:
            if special and part in self.v.special:
                yield np.array([self.v.special[part]], "<u4").tobytes()
                continue
            part = WHITE.sub(" ", unicodedata.normalize("NFC", part))
            # one character at a time: no final form of sigma
            part = part.replace("Σ", "σ").lower()
            if LATER.search(part):
                part = part.translate(LATER_LOWER)
            at = 0
            while at < len(part):
                end = part.find(" ", at + PIECE)
                yield part[at : end if end >= 0 else len(part)].split(" ")
                at = end + 1 if end >= 0 else len(part)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between, as the library has it for a file without decoder."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared: Broadcast, path: str) -> Encoder:
    """One for each worker and vocabulary file, so that what it remembers outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(shared.value)
    return _ENCODERS[path]


def _broadcast(path: str) -> Broadcast:
    return SparkContext._active_spark_context.broadcast(Vocabulary.load(path))


def encoded(text: Column, path: str) -> Column:
    """Ids of each text, packed in 4 bytes each, little-endian."""
    shared = _broadcast(path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared, path)
        for texts in common.slices(batches):
            yield pd.Series(encoder.encode_all(texts.tolist()), dtype=object)

    return F.pandas_udf(run, "binary")(text)


def decoded(ids: Column, path: str) -> Column:
    shared = _broadcast(path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared, path)
        for batch in batches:
            yield pd.Series([encoder.decode(x or b"") for x in batch], dtype=object)

    return F.pandas_udf(run, "string")(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs as ``_row`` with n_tokens, ids and the decoded text."""
    shared = _broadcast(path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared, path)
        for texts in common.slices(batches):
            ids = encoder.encode_all(texts.tolist())
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [encoder.decode(x) for x in ids]})

    both = F.pandas_udf(run, "n_tokens long, ids binary, decoded string")
    return common.packed(docs, _bpe=both(F.col("text"))).select("_row", "_bpe.*")
