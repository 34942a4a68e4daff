"""From raw message events to questions the reports can answer, on a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.text import is_direct_message, is_mention, strip_mention, thread_key


def direct_questions(messages: DataFrame) -> DataFrame:
    """Plain direct messages with their thread."""
    wanted = is_direct_message(F.col("subtype"), F.col("channel_type"), F.col("text"))
    return messages.where(wanted).select(
        "event_id", "user", "ts", _thread().alias("thread_key"), F.col("text").alias("question")
    )


def mentions(messages: DataFrame) -> DataFrame:
    """Channel messages that address the assistant, without the mention itself."""
    wanted = is_mention(F.col("subtype"), F.col("channel_type"), F.col("text"))
    return messages.where(wanted).select(
        "event_id", "user", "ts", _thread().alias("thread_key"),
        strip_mention(F.col("text")).alias("question"),
    )


def _thread():
    return thread_key(F.col("channel"), F.col("thread_ts"), F.col("ts"))
