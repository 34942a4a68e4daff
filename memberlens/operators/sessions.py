"""Idle-timeout sessions without ever sorting the raw events of a key.

Events within one bucket as long as the idle limit cannot be separated by more than that limit, so
each bucket folds to its first and last event and a count before anything is shuffled. Sessions are
then cut between buckets. What a key brings to the window is bounded by elapsed time, not by events.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.clock import micros, micros_of

# Fixed value of the message gateway.
IDLE_LIMIT = timedelta(minutes=30)


def sessions(
    events: DataFrame, keys: list[str], ts: str, idle: timedelta = IDLE_LIMIT
) -> DataFrame:
    """First and last event and event count per session; a longer pause than ``idle`` ends one."""
    gap = micros(idle)
    buckets = (
        events.where(F.col(ts).isNotNull())
        .withColumn("_bucket", F.floor(micros_of(events, ts) / gap).cast("long"))
        .groupBy(*keys, "_bucket")
        .agg(
            F.min(ts).alias("session_start"),
            F.max(ts).alias("last_event"),
            F.count("*").alias("event_count"),
        )
    )
    by_time = Window.partitionBy(*keys).orderBy("_bucket")
    pause = micros_of(buckets, "session_start") - F.lag(micros_of(buckets, "last_event")).over(
        by_time
    )
    starts = F.when(F.coalesce(pause > gap, F.lit(True)), 1).otherwise(0)
    return (
        buckets.withColumn("_starts", starts)
        .withColumn("_session", F.sum("_starts").over(by_time))
        .groupBy(*keys, "_session")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("last_event").alias("last_event"),
            F.sum("event_count").alias("event_count"),
        )
        .drop("_session")
    )


def live_threads(
    events: DataFrame, keys: list[str], ts: str, now, idle: timedelta = IDLE_LIMIT
) -> DataFrame:
    """Threads whose history is still kept at ``now``: their last write is at most ``idle`` old."""
    last = events.groupBy(*keys).agg(F.max(ts).alias("last_event"))
    at = F.lit(now).cast(events.schema[ts].dataType)
    return last.where(at - F.col("last_event") <= F.lit(idle))
