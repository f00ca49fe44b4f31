"""Broadcast behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow frame for broadcast if it has at most `rows` rows, else leave the join
    to Spark. Runs a count that stops one row beyond the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
