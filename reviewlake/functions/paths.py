"""Paths, addresses and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Directories and names of tests, and lines that import.
TEST_DIRS = ("__tests__", "spec", "specs", "test", "testing", "tests")
TEST_NAME = r"(?i)(?:^test_|_test\.|\.test\.|\.spec\.|tests?\.|spec\.)"
IMPORT_LINE = r"""(?i)^\s*(?:import\b|from\s+\S+\s+import\b|export\s+.*\s+from\b|const\s+\w+\s*=\s*require\s*\(|use\s+\S+|#include\s*[<"])"""
PR_URL = r"^https://github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([^/?#]+?)(?:\.git)?/pull/([1-9][0-9]*)(?:[/?#].*)?$"
BENCH_URL = r"^https://github\.com/([^/]+)/([^/]+)/pull/(\d+)(?:[/?#].*)?$"
ACTION_PATH_CHARS = 4_096
DEFINED = r"\b(?:async\s+)?(?:def|function|fn|func)\s+", r"\b"
TYPED = r"\b(?:class|interface|trait|struct|enum|type)\s+", r"\b"
BOUND = r"\b(?:const|let|var|static|final)\s+", r"\b"
ARROW = r"\b", r"\s*[:=]\s*(?:async\s*)?\([^\n]*\)\s*=>"
CALL = r"\b", r"\s*(?:<[^\n;()]*>)?\s*\("


def canonical_path(c: Column) -> Column:
    """Relative path with single slashes, or null if it is empty, absolute or leaves its root."""
    clean = F.replace(strip(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(clean, "/"), lambda x: (x != "") & (x != "."))
    bad = (clean == "") | clean.startswith("/") | F.array_contains(F.split(clean, "/"), "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def strict_path(c: Column) -> Column:
    """Whether a path is its own normal form, without backslash, NUL, CR or LF."""
    return F.coalesce((canonical_path(c) == c) & ~c.rlike(r"[\\\x00\r\n]"), F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | file_name(path).rlike(TEST_NAME)


def is_import(line: Column) -> Column:
    return line.rlike(IMPORT_LINE)


def quoted(c: Column) -> Column:
    """c as a pattern that matches itself."""
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def is_definition(line: Column, symbol: Column) -> Column:
    s = quoted(symbol)

    def has(before: str, after: str) -> Column:
        return F.regexp_like(line, F.concat(F.lit("(?i)" + before), s, F.lit(after)))

    return has(*DEFINED) | has(*TYPED) | has(*BOUND) | has(*ARROW)


def is_call(line: Column, symbol: Column) -> Column:
    return F.regexp_like(line, F.concat(F.lit(CALL[0]), quoted(symbol), F.lit(CALL[1])))


def _pr(c: Column, pattern: str) -> Column:
    owner, repo, number = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    number = number.try_cast("long")
    url = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/pull/"), number.cast("string"))
    return F.when(c.rlike(pattern), F.struct(owner.alias("owner"), repo.alias("repo"), number.alias("number"), url.alias("url")))


def parse_pr_url(c: Column) -> Column:
    """(owner, repo, number, url) of a pull request's address, blanks around it aside; null if it is none."""
    pr = _pr(strip(c), PR_URL)
    return F.when(~pr.repo.isin(".", "..", ""), pr)


def bench_pr_url(c: Column) -> Column:
    """As ``parse_pr_url``, by the looser rule of benchmark data: any owner and repository, any number, no blanks around."""
    return _pr(c, BENCH_URL)


def action_path(c: Column) -> Column:
    """Normal form of a path in a request, "" for the root; null if it is absolute, leaves the root, is too long or has a backslash or NUL."""
    parts = F.split(c, "/")
    unsafe = (F.length(c) > ACTION_PATH_CHARS) | c.rlike(r"[\\\x00]") | c.startswith("/") | F.array_contains(parts, "..")
    return F.when(~unsafe, F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/"))


def _component(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def case_id(url: Column) -> Column:
    pr = bench_pr_url(url)
    readable = _component(F.concat_ws("", pr.owner, F.lit("-"), pr.repo, F.lit("-pr"), pr.number.cast("string")))
    return F.when(pr.isNotNull(), F.concat(readable, F.lit("-"), F.left(F.sha2(pr.url, 256), F.lit(10))))


def model_directory(model: Column) -> Column:
    """Readable directory of a model that no other model has; null for an unsafe name."""
    name = F.replace(strip(model), F.lit("/"), F.lit("_"))
    bad = (name == "") | name.isin(".", "..") | name.rlike(r"[\\\x00\r\n]") | (F.length(name) > 200)
    return F.when(~bad, F.concat(F.left(name, F.lit(148)), F.lit("--"), F.left(F.sha2(model, 256), F.lit(10))))


def _tool_key(tool: Column, model: Column, suffix: Column, size: int) -> Column:
    name = F.concat(_component(tool), F.lit("-"), _component(model))
    ok = (_component(tool) != "") & (_component(model) != "")
    return F.when(ok, F.concat(F.regexp_replace(F.left(name, F.lit(size)), "-+$", ""), F.lit("-"), suffix))


def tool_model_id(tool: Column, model: Column, fingerprint: Column | None = None) -> Column:
    digest = F.sha2(F.concat_ws("\0", tool, model, F.lit("") if fingerprint is None else fingerprint), 256)
    return _tool_key(tool, model, F.left(digest, F.lit(12)), 83)


def fixture_tool(tool: Column, model: Column) -> Column:
    return _tool_key(tool, model, F.left(F.sha2(F.concat_ws("\0", tool, model), 256), F.lit(8)), 21)
