"""Broadcasting behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A dimension (vocabulary, mapping), marked for broadcast if it has at most ``rows`` rows; as it is beyond."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
