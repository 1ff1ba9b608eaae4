"""Size checks for reference tables that travel to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def is_short(df: DataFrame, max_rows: int) -> bool:
    """Whether a reference table has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows
