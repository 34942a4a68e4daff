"""Conversation histories cut at a clean turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.operators.lookup import top_per_key

# Fixed value of the message gateway.
MAX_MESSAGES = 40


def truncate_history(
    messages: DataFrame,
    thread: str,
    turn: str,
    is_plain_user: Column,
    max_messages: int = MAX_MESSAGES,
) -> DataFrame:
    """Keep the newest ``max_messages`` of a thread, starting at a plain user message.

    A thread that is longer is cut at the first plain user message among its newest
    ``max_messages``; without one there the whole thread is kept. Only that tail is ranked, and Spark
    limits it in each task, so a thread of any length costs a bounded sort. The cut table has one row
    per shortened thread.
    """
    # one row more than the tail tells whether the thread is too long
    tail = top_per_key(
        messages.select(thread, turn, is_plain_user.alias("_clean")),
        thread, [F.desc(turn)], max_messages + 1,
    )
    cuts = (
        tail.groupBy(thread)
        .agg(
            F.max("_rank").alias("_seen"),
            F.min(F.when(F.col("_clean") & (F.col("_rank") <= max_messages), F.col(turn))).alias(
                "_cut"
            ),
        )
        .where((F.col("_seen") > max_messages) & F.col("_cut").isNotNull())
        .select(thread, "_cut")
    )
    kept = F.col("_cut").isNull() | (F.col(turn) >= F.col("_cut"))
    return messages.join(cuts, thread, "left").where(kept).select(*messages.columns)
