"""Message events: the shape the gateway receives, from files or from the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.sources.retail import read_star

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("channel_type", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("thread_ts", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def messages_from_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as message events: turn 0 opens the thread and mentions the assistant."""
    turns = read_star(spark, folder, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    opening = F.col("turn") == 0
    return turns.select(
        F.concat(F.lit("E"), conv, F.lit("-"), turn).alias("event_id"),
        F.concat(F.lit("C"), conv).alias("channel"),
        F.when(F.col("role") == "system", "channel").otherwise("im").alias("channel_type"),
        F.when(F.col("role") == "assistant", "bot_message").alias("subtype"),
        F.when(F.col("role") == "user", F.concat(F.lit("U"), conv)).alias("user"),
        turn.alias("ts"),
        F.when(~opening, F.lit("0")).alias("thread_ts"),
        F.when(opening, F.concat(F.lit(" <@U0> "), "text", F.lit(" "))).otherwise(
            F.col("text")
        ).alias("text"),
    )


# what a micro-batch of a file stream reads at most, unless the caller says otherwise
_BOUNDED = {"maxBytesPerTrigger": str(1 << 30)}


def _limits(options: dict) -> dict:
    """``options``, with a bound on a micro-batch unless they hold one; the source takes one kind only."""
    given = {name.lower() for name in options}
    return options if given & {"maxbytespertrigger", "maxfilespertrigger"} else {**_BOUNDED, **options}


def read_message_stream(spark: SparkSession, path: str, schema=MESSAGE_SCHEMA, **options) -> DataFrame:
    """Message files as a stream; ``options`` go to the file source."""
    return spark.readStream.schema(schema).options(**_limits(options)).json(path)


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """Parquet event files as a stream."""
    return spark.readStream.schema(schema).options(**_limits(options)).parquet(path)
