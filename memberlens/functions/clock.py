"""Event time in whole microseconds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(duration: timedelta) -> int:
    return duration // timedelta(microseconds=1)


def micros_of(frame: DataFrame, column: str) -> Column:
    """Microseconds since 1970; local timestamps are read as they stand, in no time zone."""
    if not isinstance(frame.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp"))
    at = F.col(column)
    days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(at)) * 60 + F.minute(at)
    return seconds * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
