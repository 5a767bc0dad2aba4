"""Registered queries of the ledger's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import graph_queries, ledger_queries, stream_queries, text_queries

_ALL = ledger_queries.Q | text_queries.Q | graph_queries.Q | stream_queries.Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
