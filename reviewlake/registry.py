"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``reviewlake.queries``; each has QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("q_judge", "q_diffs", "q_findings", "q_repo", "q_bench", "q_jobs")


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"reviewlake.queries.{module}"), name)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
