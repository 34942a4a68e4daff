"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bits of the fixed-size filter over ids: 1 MB, whatever the number of ids
FILTER_BITS = 1 << 23
#: words whose hash a Python worker remembers
REMEMBERED_WORDS = 150_000
#: bytes of a batch that a task hands to Python; long texts make batches of few rows
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on a batch handed to Python holds BATCH_BYTES at most, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``function`` over every Arrow batch of ``frame``; no batch is kept."""
    bound_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)
                pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every value, null as none, without decoding them."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def id_order(column) -> F.Column:
    """Ids as a total order: a missing id comes before all others."""
    return F.coalesce(column.cast("long"), F.lit(-(2**63)).cast("long"))


class WordHashes(dict):
    """Word to 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a fixed bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _filter_place(column) -> F.Column:
    return F.pmod(F.xxhash64(column.cast("long")), F.lit(FILTER_BITS)) + 1


def _marked(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``frame`` with ``_maybe``: whether ``column`` may be among the single column of ``ids``, by a broadcast bitmap."""
    key = ids.columns[0]
    bitmaps = (
        ids.select(_filter_place(F.col(key)).alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap"))
    )
    placed = frame.withColumn("_place", _filter_place(F.col(column))).withColumn(
        "_bucket", F.bitmap_bucket_number("_place")
    )
    byte = "conv(hex(substring(_bitmap, cast(_bit div 8 as int) + 1, 1)), 16, 10)"
    return (
        placed.join(F.broadcast(bitmaps), "_bucket", "left")
        .withColumn("_bit", F.bitmap_bit_position("_place"))
        .withColumn("_maybe", F.expr(f"_bitmap IS NOT NULL AND (shiftright(cast({byte} as int), cast(_bit % 8 as int)) & 1) = 1"))
        .select(*frame.columns, "_maybe")
    )


def only_ids(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``frame`` whose ``column`` may be among the single column of ``ids``.

    A bitmap of fixed size (1 MB) is broadcast, so wide rows that no later join wants are dropped
    before they are shuffled. All wanted rows stay; a later join removes the few others.
    """
    return _marked(frame, column, ids).where("_maybe").drop("_maybe")


def without_ids(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``frame`` whose ``column`` is not among the single column of ``ids``; a missing one is not.

    Rows that the bitmap of ``only_ids`` rules out stay where they are; only the others meet the ids.
    """
    marked = _marked(frame, column, ids)
    sure = marked.where("_maybe IS NOT TRUE").drop("_maybe")
    unsure = marked.where("_maybe").drop("_maybe").join(ids.toDF(column), column, "left_anti")
    return sure.unionByName(unsure)
