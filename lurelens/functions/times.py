"""Date expressions. Every job takes its clock as a column, so a rerun gives the same result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_timestamp(text: Column, offsets: bool = True) -> Column:
    """ISO-8601 text to a timestamp, naive values read as UTC, NULL when unreadable. Without ``offsets`` only the strict
    form of registration records is read: a ``T`` before the time, which has seconds, and no zone but ``Z``."""
    zone = r"(?:Z|[+-]\d{2}:\d{2})?" if offsets else "Z?"
    day = r"\d{4}-\d{2}-\d{2}"
    clock = r"[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?" if offsets else r"T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?"
    text = F.regexp_replace(text, r"\A(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?\z", "$1:00$2") if offsets else text
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:\d{2})\z"), text).otherwise(F.concat(text, F.lit("Z")))
    return (
        F.when(text.rlike(rf"\A{day}\z"), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(rf"\A{day}{clock}{zone}\z"), zoned)
        .try_cast("timestamp")
    )


def days_between(earlier: Column, later: Column) -> Column:
    """Whole elapsed days, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("int")
