"""Order-dependent packing. Each group travels as lengths alone; texts are joined back by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class NextFit:
    """Group number of each length in order: a group is closed when the next item does not fit.

    sep is paid between items, base once a group. An item longer than the cap is alone in its group.
    """

    cap: int
    sep: int = 0
    base: int = 0
    max_items: int | None = None
    group: int = 0
    used: int = 0
    items: int = 0

    def add(self, n: int) -> int:
        cost = n + (self.sep if self.items else self.base)
        if self.items and (self.used + cost > self.cap or (self.max_items is not None and self.items >= self.max_items)):
            self.group, self.used, self.items, cost = self.group + 1, 0, 0, self.base + n
        self.used += cost
        self.items += 1
        return self.group


@dataclass
class SkipFit:
    """Greedy in order: what does not fit is skipped, later ones are still tried."""

    cap: int
    used: int = 0

    def add(self, n: int) -> bool:
        fits = self.used + n <= self.cap
        self.used += n if fits else 0
        return fits


def next_fit(lengths: Sequence[int], cap: int, sep: int = 0, base: int = 0, max_items: int | None = None) -> list[int]:
    return list(map(NextFit(cap, sep, base, max_items).add, lengths))


def skip_fit(lengths: Sequence[int], cap: int, base: int = 0) -> list[bool]:
    return list(map(SkipFit(cap, base).add, lengths))


def key_edges(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """Where the rows of another key begin in a batch in order of key; the first row counts."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in key:
        c = batch.column(name)
        new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def folded(df: DataFrame, key: list[str], order: list[str], length: str, start: Callable[..., NextFit | SkipFit], out: str, kind: T.DataType, given: Sequence[str] = ()) -> DataFrame:
    """df with what a fold over the lengths gives each row, in order within its key.

    Only (key, order, length) is dealt out by key and sorted; a task goes through its rows once and holds one
    state, however many rows a key has. The state of a key starts with the values that the columns given have in its first row.
    """
    rows = df.select(*key, *order, F.col(length).cast("long").alias("_n"), *[F.col(c).alias(f"_given{i}") for i, c in enumerate(given)]).repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([f for f in rows.schema.fields if f.name in (*key, *order)]).add(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, n = [], batch.column("_n").to_pylist()
            edges = key_edges(batch, key).tolist()
            for a, b in zip(edges, [*edges[1:], len(n)], strict=True):
                now = tuple(batch.column(k)[a].as_py() for k in key)
                if now != last:
                    state, last = start(*(batch.column(f"_given{i}")[a].as_py() for i in range(len(given)))), now
                values += map(state.add, n[a:b])
            kept = batch.select([*key, *order])
            yield kept.append_column(out, pa.array(values, pa.bool_() if kind == T.BooleanType() else pa.int32()))

    return df.join(rows.mapInArrow(run, schema), [*key, *order])


def pack(df: DataFrame, key: list[str], order: list[str], length: str, cap: int, sep: int = 0, base: int = 0, max_items: int | None = None, out: str = "group_index") -> DataFrame:
    """df with the next-fit group of each row within its key."""
    return folded(df, key, order, length, lambda: NextFit(cap, sep, base, max_items), out, T.IntegerType())


def fair_allocations(maximums: Sequence[int], budget: int, sep: int = 2) -> list[int]:
    """Water-filling: blocks that need less than an equal share release the rest; a remainder goes to the earliest."""
    left = max(0, budget - sep * max(0, len(maximums) - 1))
    out = [0] * len(maximums)
    waiting = sorted(range(len(maximums)), key=lambda i: (maximums[i], i))
    while waiting and maximums[waiting[0]] <= left // len(waiting):
        i = waiting.pop(0)
        out[i] = maximums[i]
        left -= maximums[i]
    if waiting:
        share, rest = divmod(left, len(waiting))
        for k, i in enumerate(sorted(waiting)):
            out[i] = share + (k < rest)
    return out


def fair_share(df: DataFrame, key: list[str], order: list[str], length: str, budget: int | Column, sep: int = 2, out: str = "allocation") -> DataFrame:
    """Water-filling by windows: a block is satisfied if its length is within the level that holds when all smaller ones are."""
    whole = Window.partitionBy(*key)
    by_size = whole.orderBy(F.col(length), *order)
    n = F.count("*").over(whole)
    total = F.greatest(F.lit(0), (F.lit(budget) if isinstance(budget, int) else budget) - sep * (n - 1))
    before = F.coalesce(F.sum(length).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.floor((total - before) / (n - F.row_number().over(by_size) + 1))
    df = df.withColumn("_total", total).withColumn("_fits", (F.col(length) <= level) & (total >= before))
    # once one does not fit, no larger one does
    df = df.withColumn("_fits", F.min(F.col("_fits").cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    df = df.withColumn("_left", F.col("_total") - F.sum(F.when(F.col("_fits"), F.col(length)).otherwise(0)).over(whole))
    df = df.withColumn("_open", F.sum(F.when(F.col("_fits"), 0).otherwise(1)).over(whole))
    nth = F.sum(F.when(F.col("_fits"), 0).otherwise(1)).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    share = F.floor(F.col("_left") / F.greatest("_open", F.lit(1))) + F.when(nth <= F.pmod("_left", F.greatest("_open", F.lit(1))), 1).otherwise(0)
    return df.withColumn(out, F.when(F.col("_fits"), F.col(length)).otherwise(share).cast("long")).drop("_total", "_fits", "_left", "_open")


def render_fitting(df: DataFrame, key: list[str], order: list[str], length: str, cap: int | str, base: int | str = 0, out: str = "kept") -> DataFrame:
    """df with a flag for each row: does it fit, in order, skipping those that do not. cap and base are numbers, or columns that are alike within a key."""
    given = [c for c in (cap, base) if isinstance(c, str)]

    def start(*values: int) -> SkipFit:
        own = iter(values)
        most, used = (next(own) if isinstance(c, str) else c for c in (cap, base))
        return SkipFit(most, used)

    return folded(df, key, order, length, start, out, T.BooleanType(), given)


def prefix_fit(df: DataFrame, key: list[str], order: list[str], cost: Column, cap: int) -> DataFrame:
    """The rows of each key, in order, while their costs add up to at most cap."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(cost).over(w)).where(F.col("_used") <= cap).drop("_used")


def grow(lengths: Sequence[int], anchor: int, cap: int) -> list[int]:
    """Rows around an anchor, nearest first and the one before ahead of the one after, each kept only if all still fit with LF between."""
    kept, used = [anchor], lengths[anchor]
    for d in range(1, len(lengths)):
        for i in (anchor - d, anchor + d):
            if 0 <= i < len(lengths) and used + 1 + lengths[i] <= cap:
                kept.append(i)
                used += 1 + lengths[i]
    return sorted(kept)


def anchor_excerpts(lines: DataFrame, anchors: DataFrame, key: list[str], file: list[str], radius: int = 18, cap: int | None = None) -> DataFrame:
    """Numbered lines around each anchor (key, file, line), grown outwards until cap: (key, excerpt).

    Lines of the window come by a join on the file and a range of line numbers.
    """
    near = anchors.join(lines, file).where(F.col("line_no").between(F.col("line") - radius, F.col("line") + radius))
    row = F.concat(F.lpad(F.col("line_no").cast("string"), 6, " "), F.lit(" | "), F.col("text"))
    lists = near.groupBy(*key).agg(F.max("line").alias("line"), F.array_sort(F.collect_list(F.struct("line_no", row.alias("row")))).alias("rows"))
    if cap is None:
        return lists.select(*key, F.array_join(F.transform("rows", lambda r: r["row"]), "\n").alias("excerpt"))

    @F.pandas_udf("string")
    def cut(numbers: pd.Series, rows: pd.Series, line: pd.Series) -> pd.Series:
        out = []
        for ns, rs, at in zip(numbers, rows, line, strict=True):
            ns, rs = list(ns), list(rs)
            kept = grow([len(r) for r in rs], ns.index(at), cap) if at in ns else []
            out.append("\n".join(rs[i] for i in kept)[:cap])
        return pd.Series(out)

    return lists.select(*key, cut(F.transform("rows", lambda r: r["line_no"]), F.transform("rows", lambda r: r["row"]), "line").alias("excerpt"))
