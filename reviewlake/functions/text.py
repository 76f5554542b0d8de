"""Text rules: lines, white space, clipping, hashes, estimates, redaction."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() takes as white space.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: What Python's str.splitlines() takes as the end of a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lf_lines(c: Column) -> Column:
    """Physical records (text, ending) of a patch: only LF or CRLF ends one; an empty rest is none."""
    parts = F.split(c, "\n", -1)
    n = F.size(parts)

    def record(x: Column, i: Column) -> Column:
        last = i == n - 1
        crlf = ~last & x.endswith("\r")
        return F.struct(F.when(crlf, F.left(x, F.length(x) - 1)).otherwise(x).alias("text"), F.when(last, "").when(crlf, "\r\n").otherwise("\n").alias("ending"))

    rows = F.transform(parts, record)
    return F.when(F.element_at(parts, -1) == "", F.slice(rows, F.lit(1), n - 1)).otherwise(rows)


def py_splitlines(c: Column) -> Column:
    """Lines of a source text; a final line end gives no empty line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def norm_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}|{WHITE}$", "")


def clip_text(c: Column, limit: Column | int, label: str) -> Column:
    """At most limit characters; what is cut ends in a marker that says so."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    marker = F.concat(F.lit(f"\n...[{label} truncated at "), limit.cast("string"), F.lit(" characters]"))
    cut = F.concat(F.left(c, F.greatest(limit - F.length(marker), F.lit(0))), marker)
    return F.when(F.length(c) <= limit, c).when(limit <= F.length(marker), F.left(marker, limit)).otherwise(cut)


def json_prefix(value: str, limit: int, json_limit: int) -> str:
    """Longest prefix of at most limit characters that takes at most json_limit in JSON, without its quotes."""
    low, high = 0, min(len(value), limit)
    while low < high:
        middle = (low + high + 1) // 2
        if len(json.dumps(value[:middle], ensure_ascii=False)) - 2 <= json_limit:
            low = middle
        else:
            high = middle - 1
    return value[:low]


def clip_json(c: Column, limit: int, json_limit: int) -> Column:
    """``json_prefix`` of a column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if v is None else json_prefix(v, limit, json_limit) for v in values], dtype=object)

    return F.pandas_udf(run, "string")(c)


def provenance(c: Column, limit: int) -> Column:
    """Length and digest of a text before it was clipped."""
    return F.struct(F.length(c).alias("original_chars"), (F.length(c) > limit).alias("truncated"), F.sha2(c, 256).alias("sha256"))


def token_estimate(c: Column) -> Column:
    """Characters by four, rounded up: an estimate, no tokenizer's output."""
    return F.floor((F.length(c) + 3) / 4).cast("long")


def utf8_bytes(c: Column) -> Column:
    return F.octet_length(c)


def nul_hash(*parts: Column, size: int = 64) -> Column:
    """SHA-256 over parts joined by NUL, its first size digits."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.left(F.sha2(joined, 256), F.lit(size))


def canonical_json(c: Column) -> Column:
    """JSON without blanks, nulls written; the fields of structs must be in order of name."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_hash(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def slug(c: Column, default: str = "value", limit: int = 64) -> Column:
    made = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.left(F.when(made == "", default).otherwise(made), F.lit(limit)), F.lit("-"))


def redact(c: Column, secrets: list[str] | None = None, limit: int = 2000) -> Column:
    """Known secrets, longest first, then what looks like one; cut at limit."""
    known = sorted({s for s in secrets or [] if s}, key=len, reverse=True)
    c = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("[REDACTED]")), known, c)
    c = F.regexp_replace(c, r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    c = F.regexp_replace(c, r"(?i)(api[_-]?key\s*[=:]\s*)[^\s,;]+", "$1[REDACTED]")
    return F.left(F.regexp_replace(c, r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"), F.lit(limit))


def wrap_untrusted(label: str, c: Column) -> Column:
    """The text between two marks whose token does not occur in it: more digits of its hash are taken until that holds."""
    digest = F.sha2(c, 256)
    token = F.coalesce(*[F.when(~F.contains(c, F.left(digest, F.lit(n))), F.left(digest, F.lit(n))) for n in range(16, 65, 8)], digest)
    return F.concat(F.lit(f"<<<{label} "), token, F.lit(">>>\n"), c, F.lit(f"\n<<<END {label} "), token, F.lit(">>>"))


def join_sections(*parts: Column) -> Column:
    """Non-empty parts with an empty line between."""
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])


def assemble_context(requested: Column, seed: Column, limit: int) -> Column:
    """What was asked for comes first, then the seed, clipped."""
    return clip_text(join_sections(requested, seed), limit, "context")
