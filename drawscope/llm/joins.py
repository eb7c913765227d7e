"""Small sides of joins: broadcast where they are counted and few, joined by shuffle beyond that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers (tens of bytes each) up to which they are broadcast.
BROADCAST_ROWS = 1 << 20


def few(rows: DataFrame) -> DataFrame:
    """``rows``, narrow and written already, to be broadcast where there are at most ``BROADCAST_ROWS``."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
