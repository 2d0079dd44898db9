"""Registered queries by name and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[f"op_{name}"] = f
        if sql:
            ORACLES[f"op_{name}"] = sql
        return f

    return put


def rounded(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)
