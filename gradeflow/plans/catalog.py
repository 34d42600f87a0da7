"""The list of registered queries: name -> Spark callable, and name -> SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions.numbers import round_to
from gradeflow.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL statement if there is one."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named columns to 6 places, as their SQL statements do."""
    return df.withColumns({c: round_to(F.col(c), 6) for c in columns})


def load_all() -> None:
    from gradeflow.plans import (  # noqa: F401
        q_compare, q_corpus, q_grading, q_pairs, q_quality, q_runs, q_scores, q_sources,
    )
