"""Joins that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast df where it is counted to have at most so many (narrow) rows; else leave it to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
