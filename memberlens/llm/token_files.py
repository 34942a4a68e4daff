"""Token ids as flat files of unsigned integers with 64-bit offsets, read back through memory maps.

A dataset is a folder: ``part-NNNNN.ids`` (ids of the part's documents one after another, little
endian), ``part-NNNNN.off`` (64-bit start of every document in the part, and the end), and
``part-NNNNN.key`` (64-bit document ids), and ``parts`` (a small table of the parts with their bases).
Parts ascend by document id. A document's start in the whole dataset is its part's base, the sum of all
ids in the parts before, plus its offset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memberlens.llm.common import bound_batches, id_order
from memberlens.llm.encoding import encoder
from memberlens.session import ensure_checkpoint_dir

#: documents read back at once
READ_AT_ONCE = 1024
PART = "part long, ids_dtype string, n_docs long, n_tokens long, name string"


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode ``docs`` in ascending id order into ``folder``; returns its parts with their bases.

    One exchange by ranges of the id; each task streams its documents to three files, so no task holds
    more than a batch. Rows of one id are ordered by their text and may be spread over parts. A missing
    text is empty, a missing id comes first and is stored as the smallest 64-bit number. A task that
    runs again writes its files anew under another name, and only the finished task's names are listed.
    """
    bound_batches(docs.sparkSession)
    ordered = docs.select(id_order(F.col(id_column)).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    spread = F.xxhash64("text")
    ranged = ordered.repartitionByRange(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", spread
    ).sortWithinPartitions("key", spread, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        docs = total = 0
        with (
            store.open_output_stream(f"{root}/{name}.ids") as ids,
            store.open_output_stream(f"{root}/{name}.off") as offsets,
            store.open_output_stream(f"{root}/{name}.key") as keys,
        ):
            offsets.write(np.array([0], "<i8").tobytes())
            for batch in batches:
                ends = []
                for text in batch.column("text"):
                    packed = encode.encode(text.as_py()) + end
                    ids.write(packed)
                    total += len(packed) // encode.dtype.itemsize
                    ends.append(total)
                docs += len(ends)
                offsets.write(np.array(ends, "<i8").tobytes())
                keys.write(batch.column("key").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        yield pa.record_batch({
            "part": pa.array([task.partitionId()], pa.int64()), "ids_dtype": pa.array([encode.dtype.str]),
            "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "name": pa.array([name]),
        })

    ranged.mapInArrow(write, PART).write.parquet(f"{folder}/written")
    written = docs.sparkSession.read.parquet(f"{folder}/written")
    # one row for each part
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based.write.parquet(f"{folder}/parts")
    return docs.sparkSession.read.parquet(f"{folder}/parts")


def _mapped(store: pa.fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as numbers: memory-mapped where the store is a mounted folder, else read."""
    if isinstance(store, pa.fs.LocalFileSystem):
        if not store.get_file_info(path).size:
            return np.empty(0, dtype)
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids as 32-bit numbers.

    A missing document id comes back as null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                path = f"{root}/{part['name']}"
                ids = _mapped(store, f"{path}.ids", part["ids_dtype"])
                offsets, keys = _mapped(store, f"{path}.off", "<i8"), _mapped(store, f"{path}.key", "<i8")
                for at in range(0, len(keys), READ_AT_ONCE):
                    own = keys[at : at + READ_AT_ONCE]
                    bounds = offsets[at : at + len(own) + 1]
                    packed = [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.record_batch({
                        "doc_id": pa.array(own, pa.int64(), mask=np.asarray(own) == -(2**63)),
                        "start": pa.array(part["base"] + np.asarray(bounds[:-1])),
                        "n_tokens": pa.array(np.diff(bounds)),
                        "ids": pa.array(packed, pa.binary()),
                    })

    parts = spark.read.parquet(f"{folder}/parts")
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids: over little-endian unsigned 32-bit integers."""
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
