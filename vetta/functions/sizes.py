"""Broadcasts behind a check of the table's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, with a broadcast hint if it has at most so many rows; a larger one is left to Spark's own choice of join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
