"""Run a stream over what has arrived so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memberlens.session import ensure_checkpoint_dir


def new_checkpoint(spark: SparkSession) -> str:
    """A folder of its own for a stream, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def process_available(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Process all files present, then stop; returns all rows written so far as a table.

    With a ``checkpoint`` folder of its own a later call goes on where this one stopped, which makes a
    scheduled job of the stream. Output and default checkpoint lie in the shared checkpoint folder.
    """
    spark = stream.sparkSession
    home = checkpoint or new_checkpoint(spark)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{home}/rows")
        .option("checkpointLocation", f"{home}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")
