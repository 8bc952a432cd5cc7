"""Query registry: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the test tables (or frames Spark derives from them) in
full. Floating outputs are rounded to 6 digits on both sides so the engines'
last-bit differences do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.plans.oracle import with_base

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(col: str) -> F.Column:
    return F.round(F.col(col), 6).alias(col)


# Query modules register themselves on import.
from dealflow.plans import q_core, q_stats, q_profile, q_chart  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLE", "register", "r6", "with_base"]
