"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 8 << 20


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether rows and bytes stay within the bounds.

    Measuring stops after max_rows + 1 rows, whatever the size. A row counts with the
    length of its text form, which is at least what its values take.
    """
    size = F.length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    rows, size_sum = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and size_sum <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a side that proves small; otherwise leave the join to the planner."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
