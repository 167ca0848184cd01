"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("tables", "ingest", "understand", "edit", "manage", "streams", "flows")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for m in MODULES:
        mod = import_module(f"cliploom.catalog.{m}")
        for name, (fn, text) in mod.QUERIES.items():
            queries[name] = fn
            if text is not None:
                sql[name] = text
    return queries, sql
