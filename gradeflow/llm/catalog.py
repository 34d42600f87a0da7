"""The queries of this folder: name -> callable, and name -> SQL statement."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = [
    "url_filters", "substring_dedup", "decontaminate", "ngram_join", "line_dedup", "embedding_dedup", "token_counts", "packing",
    "licenses", "toxicity", "merkle", "conversations", "token_store",
]


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name, with its SQL statement if there is one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"gradeflow.llm.{name}")
