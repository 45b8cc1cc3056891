"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows that may go to every task.
NEAR_ROWS = 500_000


def small(df: DataFrame, most: int = NEAR_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further."""
    return df.limit(most + 1).count() <= most


def near(df: DataFrame, most: int = NEAR_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is, for the planner to exchange."""
    return F.broadcast(df) if small(df, most) else df
