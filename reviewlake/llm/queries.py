"""One query for each operator of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLE.
MODULES = ("q_line_dedup", "q_quality", "q_bpe", "q_lang_id", "q_suffixes", "q_token_counts", "q_pii", "q_simhash", "q_brown", "q_decontam", "q_mixing", "q_runs", "q_trie")


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"reviewlake.llm.{module}"), name)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
