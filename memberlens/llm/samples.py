"""A bounded sample of labelled documents as numbers, for classifiers that are fitted in memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import map_batches, texts_of

#: labelled documents that a classifier is fitted on at most, taken by a hash of their ids
SAMPLE = 20_000
FOLDS = 5


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out. Null for a missing id."""
    return F.when(doc_id.isNotNull(), F.crc32(doc_id.cast("string").cast("binary")) % FOLDS)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """(id, text, label) of up to ``limit`` labelled ids that are not held out.

    Labels other than 0 and 1 are left out; of several labels of one id the largest counts. The ids are picked
    first, by a hash of the id (at most ``limit`` of them are broadcast), so only their texts are read out.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) > 0))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return named.join(F.broadcast(ids), F.col("id") == F.col("_id")).select("id", "text", F.col("_label").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, features: Callable[[bytes], list[float]], limit: int = SAMPLE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, folds) of ``labelled_texts``; of several texts of one id that with the largest features."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(text) for text in texts_of(batch.column("text"))]
        return pa.record_batch({
            "id": batch.column("id"), "label": batch.column("label"), "row": pa.array(rows, pa.list_(pa.float64())),
        })

    rows = map_batches(labelled_texts(docs, labels, label, limit), of, "id long, label int, row array<double>")
    taken = rows.groupBy("id").agg(F.max("label").alias("label"), F.max("row").alias("row"))
    taken = taken.orderBy("id").select("row", "label", fold(F.col("id")).alias("fold")).toPandas()
    if taken.empty:
        return np.empty((0, len(features(b"")))), np.empty(0), np.empty(0)
    return np.array(taken["row"].tolist(), float), taken["label"].to_numpy(float), taken["fold"].to_numpy(int)


def scored(docs: DataFrame, column: str, score: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """``docs`` with a double ``column`` of ``score`` over every batch of whole texts; a missing text is empty.

    All columns pass through; one of the same name is replaced.
    """
    kept = docs.drop(column)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = score(list(texts_of(batch.column(batch.schema.get_field_index("text")))))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, column]
        )

    return map_batches(kept, of, f"{schema}, {column} double")
