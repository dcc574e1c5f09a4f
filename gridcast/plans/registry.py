"""Name -> (DataFrame query, SQL)."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; results are compared to ``digits`` places."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def rounds(*columns: str, digits: int = 6) -> str:
    """The same in SQL."""
    return ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in columns)
