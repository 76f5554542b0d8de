"""What a verifier batch shows: patch, generation context and source around each finding, each block cut around its anchor to its share.

A batch has few findings, so its blocks meet in one row. Lines of source come by a range join on their file; the patch is the finding's own chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import context as packets
from .packing import fair_allocations, grow

# Heads of blocks, lines around an anchor in patch and source, and what is shown of a patch without the anchor.
PATCH_HEAD, SOURCE_HEAD, CONTEXT_HEAD = "### candidate {index}: {path}:{line}\n", "### {side} source: {path}:{line}\n", "### generation context: {chunk_id}\n"
PATCH_RADIUS, SOURCE_RADIUS, NO_ANCHOR_CHARS = 14, 18, 8_000
KEY = ["review_id", "batch_offset"]
MADE = (
    "patch string, context string, patch_available long, patch_rendered long, patch_blocks long, patch_blocks_rendered long, generation_available long, generation_rendered long, generation_blocks long, "
    "generation_blocks_rendered long, source_available long, source_rendered long, source_blocks long, source_blocks_rendered long, generation_text string, source_text string, source_paths array<string>"
)
NAMES = [x.split()[0] for x in MADE.split(", ")]


def around(rows: list[str], anchor: int, cap: int) -> str:
    """The rows around the anchor that fit, nearest first; an anchor too long alone is cut."""
    return "\n".join(rows[i] for i in grow([len(r) for r in rows], anchor, cap))[:cap] if rows and cap > 0 else ""


def patch_window(patch: str, side: str, line: int) -> tuple[list[str], int | None]:
    """Rows of a chunk's patch around a line, and the anchor's place among them; None, and the whole patch, if no row has it."""
    rows, mark = patch.splitlines(), f"{'R' if side == 'RIGHT' else 'L'}{line}"
    at = next((i for i, row in enumerate(rows) if mark in row.split(" | ", 1)[0]), None)
    if at is None:
        return [patch], None
    first = max(0, at - PATCH_RADIUS)
    return rows[first : at + PATCH_RADIUS + 1], at - first


def rendered(found: list[dict], contexts: list[dict], patch_budget: int, context_budget: int) -> tuple:
    """The values of MADE for one batch: found in order of candidates, contexts once each in order of their first finding."""
    patch, source = {}, {}
    for f in found:
        if f["patch"] is not None:
            patch.setdefault((f["chunk_id"], f["side"], f["line"]), f)
        if f["rows"]:
            source.setdefault((f["side"], f["path"], f["line"]), f)
    blocks = []  # (head, rows, anchor, text as a whole)
    for f in patch.values():
        rows, at = patch_window(f["patch"], f["side"], f["line"])
        blocks.append((PATCH_HEAD.format(**f), rows, at, "\n".join(rows) if at is not None else f["patch"][:NO_ANCHOR_CHARS]))
    sources = []
    for f in source.values():
        rows = [f"{x['line_no']:>6} | {x['text']}" for x in f["rows"]]
        at = next((i for i, x in enumerate(f["rows"]) if x["line_no"] == f["line"]), 0)
        sources.append((SOURCE_HEAD.format(**f), rows, at, "\n".join(rows)))
    own = [(CONTEXT_HEAD.format(**c), c["context"]) for c in contexts]

    def cut(specs: list[tuple], budget: int) -> tuple[str, int]:
        out, shown = [], 0
        for (head, rows, at, _), n in zip(specs, fair_allocations([len(h) + len(whole) for h, _, _, whole in specs], budget), strict=True):
            rest = n - len(head)
            if n > 0:
                out.append(head[:n] if rest <= 0 else head + (around(rows, at, rest) if at is not None else rows[0][:rest]))
            shown += rest > 0
        return "\n\n".join(out), shown

    whole = lambda specs: sum(len(s[0]) + len(s[-1]) for s in specs) + 2 * max(0, len(specs) - 1)
    all_context, all_source = whole(own), whole(sources)
    # of two classes each has half before what one leaves goes to the other
    room = max(0, context_budget - (2 if own and sources else 0))
    for_context = min(all_context, room // 2) if own and sources else min(all_context, room)
    for_source = min(all_source, room - for_context)
    for_context = min(all_context, room - for_source) if own and sources else for_context
    shares = fair_allocations([len(h) + len(t) for h, t in own], for_context)
    context_text = "\n\n".join((h + t)[:n] for (h, t), n in zip(own, shares, strict=True) if n > 0)
    source_text, source_shown = cut(sources, for_source)
    patch_text, patch_shown = cut(blocks, patch_budget)
    return (
        patch_text, "\n\n".join(x for x in (context_text, source_text) if x), whole(blocks), len(patch_text), len(blocks), patch_shown, all_context, len(context_text), len(own), sum(n > len(h) for (h, _), n in zip(own, shares, strict=True)),
        all_source, len(source_text), len(sources), source_shown, context_text, source_text, sorted({f["path"] for f in source.values()}),
    )


def batch_evidence(found: DataFrame, chunks: DataFrame, contexts: DataFrame, lines: DataFrame, patch_budget: int = 72_000, context_budget: int = 48_000) -> DataFrame:
    """(review_id, batch_offset, MADE) of verifier batches.

    found: (review_id, seq, batch_offset, candidate_index, chunk_id, side, path, line, commit_sha), commit_sha being that of the side; chunks: (review_id, chunk_id,
    annotated_patch); contexts: (review_id, chunk_id, context); lines: (commit_sha, path, line_no, text). Contexts that are alike in a batch are shown once.
    """
    near = found.select("review_id", "seq", "commit_sha", "path", "line").join(lines, ["commit_sha", "path"]).where(F.col("line_no").between(F.col("line") - SOURCE_RADIUS, F.col("line") + SOURCE_RADIUS))
    # no block has more of a line than the budget
    near = near.groupBy("review_id", "seq").agg(F.array_sort(F.collect_list(F.struct("line_no", F.left("text", F.lit(context_budget + 1)).alias("text")))).alias("rows"))
    one = found.join(near, ["review_id", "seq"], "left").join(chunks.select("review_id", "chunk_id", F.col("annotated_patch").alias("patch")), ["review_id", "chunk_id"], "left")
    specs = one.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("candidate_index").alias("index"), "chunk_id", "side", "path", "line", "patch", "rows"))).alias("found"))
    shown = found.groupBy(*KEY, "chunk_id").agg(F.min("candidate_index").alias("index")).join(contexts.where("context <> ''").select("review_id", "chunk_id", "context"), ["review_id", "chunk_id"])
    first = F.row_number().over(Window.partitionBy(*KEY, F.sha2("context", 256)).orderBy("index"))
    shown = shown.withColumn("_n", first).where("_n = 1").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("index", "chunk_id", "context"))).alias("contexts"))

    rows = specs.join(shown, KEY, "left").select(*KEY, "found", "contexts")
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEY] + [MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is a whole batch of findings with their texts: one at a time
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            made = rendered(row.column("found")[0].as_py(), row.column("contexts")[0].as_py() or [], patch_budget, context_budget)
            values = [pa.array([v], pa.list_(pa.string()) if isinstance(v, list) else pa.string() if isinstance(v, str) else pa.int64()) for v in made]
            yield pa.RecordBatch.from_arrays([*(row.column(k) for k in KEY), *values], names=[*KEY, *NAMES])

    return rows.mapInArrow(run, schema)


def evidence_files(made: DataFrame, found: DataFrame, context_files: DataFrame) -> DataFrame:
    """(review_id, batch_offset, kind, path, rendered): files that each class of a batch has, and whether its text really shows them.

    made: ``batch_evidence``; context_files: (review_id, chunk_id, path), what generation contexts show.
    """
    batch = F.struct(*KEY)
    of = lambda kind, column, paths: packets.exposed_paths(made.select(batch.alias("review_id"), F.col(column).alias("context")), paths.select(batch.alias("review_id"), "path")).select("review_id.*", "path", F.lit(kind).alias("kind"))
    own = found.drop("path").join(context_files, ["review_id", "chunk_id"]).select(*KEY, "path").distinct()
    source = made.select(*KEY, F.explode("source_paths").alias("path"))
    there = own.withColumn("kind", F.lit("generation")).unionByName(source.withColumn("kind", F.lit("source")))
    shown = of("generation", "generation_text", own).unionByName(of("source", "source_text", source)).withColumn("rendered", F.lit(True))
    return there.join(shown, [*KEY, "kind", "path"], "left").withColumn("rendered", F.coalesce("rendered", F.lit(False)))
