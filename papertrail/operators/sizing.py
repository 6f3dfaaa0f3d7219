"""Size checks that guard every broadcast.

A side is broadcast only after a bounded count proves it small; beyond
the bound the plain join is returned and Spark shuffles both sides
(AQE then splits skewed partitions).  The check runs ``limit(n+1)``,
so it never scans more than ``n+1`` rows of the candidate side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 2_000_000


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if ``df`` has at most ``max_rows`` rows, else ``df``."""
    return F.broadcast(df) if has_at_most(df, max_rows) else df
