"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few columns that go to every executor at most; more are joined by a shuffle.
MOST = 200_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` marked for a broadcast if it has ``most`` rows at most, which is counted first, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
