"""From raw message events to the questions that are answered, as one job.

Messages addressed to the assistant (direct messages, and mentions elsewhere) are de-duplicated by event
id, then limited per user; a repeated delivery does not count against the limit, and messages without a
user are not limited. Accepted questions carry their thread, whose newest ones are remembered.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.text import is_direct_message, is_mention, strip_mention, thread_key
from memberlens.operators.admission import (
    RATE_LIMIT, RATE_WINDOW, SEEN_TTL, mark_duplicates, mark_rate_limited,
)
from memberlens.operators.history import MAX_MESSAGES, truncate_history
from memberlens.operators.sessions import IDLE_LIMIT
from memberlens.streaming.admission import mark_duplicates_stream, mark_rate_limited_stream
from memberlens.streaming.history import remember_stream


def addressed(messages: DataFrame) -> DataFrame:
    """event_id, user, at (time of ``ts``, seconds as text), thread_key, question; works on streams too."""
    kind = (F.col("subtype"), F.col("channel_type"), F.col("text"))
    direct = is_direct_message(*kind)
    at = F.timestamp_micros((F.col("ts").cast("decimal(20,6)") * 1_000_000).cast("long"))
    return messages.where(direct | is_mention(*kind)).select(
        "event_id", "user", at.alias("at"),
        thread_key(F.col("channel"), F.col("thread_ts"), F.col("ts")).alias("thread_key"),
        F.when(direct, F.col("text")).otherwise(strip_mention(F.col("text"))).alias("question"),
    )


def intake(
    messages: DataFrame,
    limit: int = RATE_LIMIT,
    window: timedelta = RATE_WINDOW,
    ttl: timedelta = SEEN_TTL,
) -> DataFrame:
    """Every new question once, with ``is_limited`` where its user has to wait."""
    marked = mark_duplicates(addressed(messages), ["event_id"], "at", "event_id", ttl)
    fresh = marked.where(~F.col("is_duplicate")).drop("is_duplicate")
    return mark_rate_limited(fresh, ["user"], "at", "event_id", limit, window)


def remembered(questions: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """The accepted questions of :func:`intake` that their threads still remember at the end."""
    accepted = questions.where(~F.col("is_limited")).drop("is_limited")
    return truncate_history(accepted, "thread_key", "at", F.lit(True), max_messages)


def intake_stream(
    messages: DataFrame,
    limit: int = RATE_LIMIT,
    window: timedelta = RATE_WINDOW,
    ttl: timedelta = SEEN_TTL,
    max_messages: int = MAX_MESSAGES,
    idle: timedelta = IDLE_LIMIT,
    buckets: int | None = None,
) -> DataFrame:
    """:func:`intake` on a stream of messages, with what each question's thread then remembers.

    One query of three stateful operators after one another: de-duplication by event id, rate limit by user,
    history by thread. ``history_length`` counts the question itself; limited ones are not
    remembered and have none. A redelivery in a later micro-batch is a duplicate like any other.
    """
    marked = mark_duplicates_stream(addressed(messages), ["event_id"], "at", "event_id", ttl, buckets=buckets, chained=True)
    fresh = marked.where(~F.col("is_duplicate")).drop("is_duplicate")
    limited = mark_rate_limited_stream(fresh, ["user"], "at", "event_id", limit, window, buckets=buckets, chained=True)
    placed = limited.withColumn("place", F.unix_micros("at"))
    kept = remember_stream(
        placed, "thread_key", "at", "place", F.lit(True), idle, max_messages,
        taken=~F.col("is_limited"), buckets=buckets, chained=True,
    )
    return kept.drop("place", "history_start")
