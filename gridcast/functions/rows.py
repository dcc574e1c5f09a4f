"""Arrays to rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unpack(df: DataFrame, keep: list[str], array: str | Column, position: str, value: str) -> DataFrame:
    """One row per element of a computed array.

    A plain POSEXPLODE makes the optimizer guess ``size(array) > 0`` and evaluate the array's whole expression
    once more in a pushed-down filter. The outer form guesses nothing; empty arrays are dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())
