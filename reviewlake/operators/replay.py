"""Replay of the rounds in which a model asks for lists, ranges of lines and literals, with all that depends on what came before.

What a request could show is found by joins for all requests at once. What it does show depends on those before it in its batch: which cursor
was offered last, which files are known, how much room is left. A batch's requests go through one state in order; the state holds its
keys, cursors and files, whose number its rounds and requests bound, and rows hold no more text than a request may show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repo
from .ordered import few

# How a request's result is headed, and what stands for nothing.
LIST_HEAD = "UNTRUSTED INVENTORY LIST more={more} prefix={prefix} after={after}"
READ_HEAD = "UNTRUSTED IMMUTABLE HEAD FILE {path} L{start}-L{end}"
SEARCH_HEAD = "UNTRUSTED LITERAL SEARCH more={more} capped={capped} start={start:08d} next_start={next_start:08d} query={query} prefix={prefix}"
NO_SUCH_PREFIX = "UNTRUSTED LITERAL SEARCH\n[no matching paths]"
NO_PATHS, NO_MATCHES, BEYOND = "[no matching paths]", "[no matches]", "[requested range is beyond end of file]"
ROOT, FROM_START = "[repository root]", "[start]"


@dataclass(frozen=True)
class Limits:
    page: int = 12
    read_chars: int = 24_000
    read_lines: int = 400
    files: int = 16
    context_chars: int = 120_000
    requests: int = 8
    rounds: int = 2
    max_offset: int = 100_000


@dataclass
class Outcome:
    """What became of a request. Texts of lists are for the model alone, those of reads and searches are evidence."""

    outcome: str
    reason: str | None = None
    shown: int = 0
    more: bool = False
    capped: bool = False
    next_start: int | None = None
    next_cursor: str | None = None
    new_files: list[str] = field(default_factory=list)
    text: str | None = None


def marked_cut(text: str, limit: int, label: str) -> str:
    """At most limit characters of text; what is cut ends in a mark that says so."""
    mark = f"\n...[{label} truncated at {limit} characters]"
    if len(text) <= limit:
        return text
    return mark[:limit] if limit <= len(mark) else text[: limit - len(mark)] + mark


def whole_rows(head: str, rows: list[str], limit: int) -> tuple[str, int]:
    """head and the rows behind it that fit whole, and their number."""
    if len(head) >= limit:
        return head[:limit], 0
    used, n = len(head), 0
    for row in rows:
        used += 1 + len(row)
        if used > limit:
            break
        n += 1
    return "\n".join([head, *rows[:n]]), n


def hit_rows(head: str, rows: list[tuple[str, str]], limit: int) -> tuple[str, int] | None:
    """head and rows (place, text), the last one cut if its place at least fits; None if no row does."""
    out, used = [head], len(head)
    for place, text in rows if used < limit else []:
        left = limit - used - 1
        if left < len(place):
            break
        row = place + marked_cut(text, left - len(place), "search result text")
        out.append(row)
        used += 1 + len(row)
        if len(place) + len(text) > left:
            break
    return ("\n".join(out), len(out) - 1) if len(out) > 1 else None


@dataclass
class Selection:
    """State of one batch."""

    limits: Limits
    room: int
    seen: set = field(default_factory=set)
    starts: dict = field(default_factory=dict)
    cursors: dict = field(default_factory=dict)
    offered_starts: dict = field(default_factory=dict)
    offered_cursors: dict = field(default_factory=dict)
    files: set = field(default_factory=set)
    round: int | None = None
    rounds: int = 0
    used: int = 0
    pieces: int = 0
    ended: str | None = None
    last: bool = False

    def take(self, r: dict) -> Outcome:
        """The outcome of the next request, in order of round and place."""
        if r["round"] != self.round:
            # what a round offers can be asked for in the next one
            self.round, self.rounds = r["round"], self.rounds + 1
            self.offered_starts, self.offered_cursors = dict(self.starts), dict(self.cursors)
            if self.last:
                self.ended = self.ended or "selection is done"
            elif self.rounds > self.limits.rounds:
                self.ended = self.ended or "round limit"
        self.last = self.last or bool(r["done"])
        if self.ended:
            return Outcome("not reached", self.ended)
        if r["error"]:
            return Outcome("refused", r["error"])
        action, path, query, start = r["action"], r["path"], r["query"], r["start_line"]
        start = (start or 1) if action == "search" else start
        key = (action, path, query, start, r["end_line"])
        if key in self.seen:
            return Outcome("duplicate")
        if action == "search" and self.offered_starts.get((path, query), 1) != start:
            return Outcome("refused", "cursor was not offered")
        if action == "list" and self.offered_cursors.get(path, "") != query:
            return Outcome("refused", "cursor was not offered")
        self.seen.add(key)
        room = self.room - self.used
        if room <= 0:
            self.ended = "no room"
            return Outcome("not reached", self.ended)
        limit = min(self.limits.read_chars, room)
        made = getattr(self, f"_{action}")(r, limit, start)
        if made.outcome == "served" and action != "list":
            text = marked_cut(made.text, room, "selected context")
            self.files.update(made.new_files)
            if text:
                self.pieces += 1
                self.used += len(text) + (2 if self.pieces > 1 else 0)
            if text != made.text:
                made.text, self.ended = text, "no room"
        return made

    def _list(self, r: dict, limit: int, start: int | None) -> Outcome:
        paths, prefix = [x["path"] for x in r["rows"]], r["path"]
        head = lambda more: LIST_HEAD.format(more=more, prefix=prefix or ROOT, after=r["query"] or FROM_START)
        shown = min(whole_rows(head("?"), paths or [NO_PATHS], limit)[1], len(paths))
        more = r["more"] or shown < len(paths) or (not paths and len(head("?")) + 1 + len(NO_PATHS) > limit)
        text = whole_rows(head("Y" if more else "N"), paths or [NO_PATHS], limit)[0]
        self.cursors[prefix] = paths[shown - 1] if more and shown else None
        return Outcome("served", shown=shown, more=more, next_cursor=self.cursors[prefix], text=text)

    def _read(self, r: dict, limit: int, start: int) -> Outcome:
        path = r["path"]
        if not r["known"]:
            return Outcome("failed", "path is not in the tree")
        if path not in self.files and len(self.files) >= self.limits.files:
            return Outcome("failed", "file limit")
        if r["fault"]:
            return Outcome("failed", r["fault"])
        rows = [f"{x['line_no']:>7} | {x['text']}" for x in r["rows"]]
        head = READ_HEAD.format(path=path, start=start, end=min(r["end_line"], r["n_lines"]))
        text, shown = whole_rows(head, rows or [BEYOND], limit)
        shown = min(shown, len(rows))
        return Outcome("served", shown=shown, more=shown < len(rows), new_files=[path] if shown and path not in self.files else [], text=text)

    def _search(self, r: dict, limit: int, start: int) -> Outcome:
        key = r["path"], r["query"]
        if not r["known"]:
            self.starts[key] = None
            return Outcome("served", text=NO_SUCH_PREFIX)
        # files that are known are free; of others, so many as there are places
        page, kept, fresh = r["rows"], [], []
        for nth, x in enumerate(page, start):
            if x["path"] not in self.files and x["path"] not in fresh:
                if len(self.files) + len(fresh) >= self.limits.files:
                    continue
                fresh.append(x["path"])
            kept.append((nth, x))
        rows = [(f"{x['path']}:{x['line_no']}: ", x["text"]) for _, x in kept] or [(NO_MATCHES, "")]
        head = lambda more, capped, after: SEARCH_HEAD.format(more=more, capped=capped, start=start, next_start=after, query=r["query"], prefix=r["path"] or ROOT)
        made = hit_rows(head("?", "?", start), rows, limit)
        if made is None:
            return Outcome("failed", "no hit fits")
        shown = min(made[1], len(kept))
        after = kept[shown - 1][0] + 1 if shown else start + len(page)
        more = bool(r["more"]) or shown < len(kept) or len(kept) < len(page)
        capped = more and after > self.limits.max_offset
        after = min(after, self.limits.max_offset)
        text = hit_rows(head("Y" if more else "N", "Y" if capped else "N", after), rows, limit)[0]
        self.starts[key] = after if more and not capped and after > start else None
        files = list(dict.fromkeys(x["path"] for _, x in kept[:shown] if x["path"] not in self.files))
        return Outcome("served", shown=shown, more=more, capped=capped, next_start=self.starts[key], new_files=files, text=text)


def possible(requests: DataFrame, tree: DataFrame, lines: DataFrame, limits: Limits = Limits(), index: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """requests (request_id, commit_sha, and the columns of ``repo.validate_requests``) with what each can show: rows, more, known, n_lines and fault.

    tree: (commit_sha, path), with bytes and is_binary if known. A row has no more text than a request may show, and a read no more rows.
    """
    sound = requests.where("error is null")
    asks = lambda action: sound.where(F.col("action") == action)
    cut = F.left("text", F.lit(limits.read_chars + 1))
    rows_of = lambda df, order: df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("place"), "path", "line_no", "text"))).alias("rows"), F.bool_or("more").alias("more"))
    prefixed = lambda df: df.select("request_id", "commit_sha", F.col("path").alias("prefix"), F.nullif(F.col("query"), F.lit("")).alias("cursor"))
    listed = repo.path_list(prefixed(asks("list")), tree, limits.page, paths)
    listed = rows_of(listed.withColumns({"line_no": F.lit(0), "text": F.lit("")}), "place")
    wanted = asks("search").select("request_id", "commit_sha", F.col("path").alias("prefix"), "query", F.col("start_line").alias("start"))
    hits = repo.literal_search(wanted, lines, limits.page, limits.max_offset, index)
    hits = rows_of(hits.withColumn("text", cut), "hit_no")
    begun = repo.path_list(prefixed(asks("search").withColumn("query", F.lit(""))), tree, 1, paths).select("request_id").distinct()
    own = asks("read").select("request_id", "commit_sha", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    read = repo.line_range_read(own, lines).withColumn("text", cut)
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("request_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    read = rows_of(read.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") <= limits.read_chars).withColumn("more", F.lit(False)), "line_no")
    files = few(own.select("commit_sha", "path").distinct())
    sizes = lines.join(files, ["commit_sha", "path"], "left_semi").groupBy("commit_sha", "path").agg(F.max("line_no").alias("n_lines"))
    fault = F.when(F.col("bytes") > 2_000_000, "file is too large") if "bytes" in tree.columns else F.lit(None).cast("string")
    fault = F.coalesce(fault, F.when(F.col("is_binary"), "file is binary")) if "is_binary" in tree.columns else fault
    there = own.select("request_id", "commit_sha", "path").join(tree.join(files, ["commit_sha", "path"], "left_semi").withColumn("fault", fault).select("commit_sha", "path", "fault").distinct(), ["commit_sha", "path"]).join(sizes, ["commit_sha", "path"], "left").select("request_id", "n_lines", "fault")
    found = listed.unionByName(hits).unionByName(read)
    known = begun.withColumns({"n_lines": F.lit(0), "fault": F.lit(None).cast("string")}).unionByName(there).withColumn("known", F.lit(True))
    out = requests.join(found, "request_id", "left").join(known, "request_id", "left")
    return out.withColumns({"known": F.coalesce("known", F.lit(False)), "more": F.coalesce("more", F.lit(False)), "n_lines": F.coalesce("n_lines", F.lit(0))})


OUTCOME = "outcome string, reason string, shown int, more boolean, capped boolean, next_start int, next_cursor string, new_files array<string>, text string"
KEY = ["review_id", "batch_id"]


def replay(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(request_id, review_id, batch_id, round, seq, action, path, OUTCOME) of requests with what each can show (``possible``).

    done (boolean), if there, ends a batch's selection with the round of a row where it holds; seed_chars, if there, are taken off its room.
    """
    have = requests.columns
    seed = F.coalesce("seed_chars", F.lit(0)) if "seed_chars" in have else F.lit(0)
    room = (F.lit(limits.context_chars) - seed - F.when(seed > 0, 2).otherwise(0)).cast("long")
    rows = requests.select(
        "request_id", *KEY, "round", "seq", "action", "path", F.coalesce("query", F.lit("")).alias("query"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "error",
        F.coalesce("done", F.lit(False)).alias("done") if "done" in have else F.lit(False).alias("done"), room.alias("room"), "rows", "more", "known", F.col("n_lines").cast("int").alias("n_lines"), "fault",
    )
    kept = ["request_id", *KEY, "round", "seq", "action", "path"]
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [OUTCOME])
    names = [x.split()[0] for x in OUTCOME.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                r["rows"] = r["rows"] or []
                if (key := (r["review_id"], r["batch_id"])) != last:
                    state, last = Selection(limits, r["room"]), key
                made.append(state.take(r))
            columns = [batch.column(c) for c in kept] + [pa.array([getattr(o, n) for o in made], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "round", "seq").mapInArrow(run, schema)


def served_context(outcomes: DataFrame) -> DataFrame:
    """(review_id, batch_id, context, files): the evidence of each batch in order, and the files that it shows."""
    good = outcomes.where("outcome = 'served'")
    texts = F.array_sort(F.collect_list(F.when((F.col("action") != "list") & (F.col("text") != ""), F.struct("round", "seq", "text"))))
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list("new_files"))))
    return good.groupBy(*KEY).agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("context"), files.alias("files"))
