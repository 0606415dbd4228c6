"""Time columns that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column."""
    span = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = span.cast("interval second").cast("decimal(24,6)")
    return (seconds * 1000000).cast("bigint")


def still_valid(expires: Column, as_of: Column) -> Column:
    """A row without expiry, or whose expiry lies after `as_of`."""
    return expires.isNull() | (expires > as_of)
