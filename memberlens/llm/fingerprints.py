"""Document fingerprints: a digest of bucket quartiles over hashed byte triplets, and its likeness.

Every three neighbouring bytes are hashed into one of 256 buckets. A bucket's code tells between
which quartiles of all bucket counts its count lies (two bits). The digest is one byte for the length on
a logarithmic scale, then the codes, as lowercase hex. Two digests differ by the sum of their codes'
distances plus that of their lengths; the sum is bounded by what unrelated digests reach, so the likeness
``1 - difference / bound`` is 1 for equal digests and about 0 for unrelated ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import bound_batches, id_order

BUCKETS = 256
#: a distance of three quartiles weighs as much as six of one
WEIGHTS = np.array([0, 1, 2, 6], np.int64)
#: mean difference of independent codes, and so the bound of the difference
BOUND = int(BUCKETS * 1.625)
LENGTH_WEIGHT = 4
#: ranges of ids for each shuffle partition, so that ranges of unequal size even out
RANGES = 8


def _codes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    if len(data) < 3:
        counts = np.zeros(BUCKETS, np.int64)
    else:
        wide = data.astype(np.uint32)
        triplets = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
        counts = np.bincount((triplets * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    ranked = np.sort(counts)
    quartiles = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1)
    return np.concatenate([[min(255, int(8 * np.log2(len(data) + 1)))], codes])


def _digest(codes: np.ndarray) -> str:
    four = codes[1:].reshape(-1, 4)
    packed = (four << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    return bytes([codes[0]]).hex() + packed.tobytes().hex()


def fingerprint(text: bytes) -> str:
    """The digest of any bytes; fewer than three bytes have no triplets."""
    return _digest(_codes(text))


def _read(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.concatenate([raw[:1], ((raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)]).astype(np.int64)


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    apart = int(WEIGHTS[np.abs(a[1:] - b[1:])].sum()) + LENGTH_WEIGHT * abs(int(a[0]) - int(b[0])) // 8
    return 1.0 - min(apart, BOUND) / BOUND


def likeness(a: str, b: str) -> float:
    """0 to 1 for two digests; 1 for equal ones."""
    return _alike(_read(a), _read(b))


def fingerprints(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; a missing text counts as empty."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: fingerprint((t or "").encode()))

    return docs.withColumn("fingerprint", of(F.col(text_column)))


def with_successors(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(range_no, guest, key, text): documents in ranges of descending id, each range followed by the
    first document of the next range (the last range by the first document of all) as a guest.

    The ids alone are range-partitioned first, which gives the ranges' first ids; then every row is sent
    to its range in one exchange. Ties of id are ordered by text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    narrow = docs.select(
        id_order(F.col(id_column)).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                highest = batch.column("key").to_numpy().max()
                best = highest if best is None else max(best, highest)
        if best is not None:
            yield pa.record_batch({"key": pa.array([best], pa.int64())})

    ranged = narrow.select("key").repartitionByRange(parts, F.desc("key")).mapInArrow(top, "key long")
    firsts = np.sort(np.array([r[0] for r in ranged.collect()], np.int64))  # one id for each range

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(firsts)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            place = np.searchsorted(firsts, keys, "left")  # ascending place of the range that starts at or above
            own = pa.array(count - 1 - place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(np.zeros(len(keys), np.int32)), batch.column("key"), batch.column("text")],
                ["range_no", "guest", "key", "text"],
            )
            heads = np.flatnonzero(firsts[place] == keys)
            if len(heads):
                picked = batch.take(pa.array(heads))
                before = (count - 1 - place[heads] - 1) % count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before, pa.int64()), pa.array(np.ones(len(heads), np.int32)), picked.column("key"), picked.column("text")],
                    ["range_no", "guest", "key", "text"],
                )

    schema = "range_no long, guest int, key long, text string"
    sent = narrow.mapInArrow(dealt, schema)
    return sent.repartition("range_no").sortWithinPartitions("range_no", "guest", F.desc("key"), "text")


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    The next document is that of the next lower id (after the last, the first). The edited text has its
    last ``floor(n/2)`` code points replaced by as many first ones of the next text. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A missing text is empty,
    a missing id is the lowest; rows of one id follow each other in the order of their texts; one document
    alone is its own next. Other columns are ignored.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last own document: range, key, text, codes
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(k).to_pylist() for k in ("range_no", "guest", "key", "text")), strict=True)
            for number, guest, key, text in rows:
                if guest and held is None:
                    continue
                codes = _codes(text.encode())
                if held is not None and held[0] == number:
                    out.append(_pair(*held[1:], text, codes))
                held = None if guest else (number, key, text, codes)
            if out:
                yield pa.record_batch(dict(zip(NAMES, map(pa.array, zip(*out, strict=True)), strict=True)))

    schema = (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    compared = with_successors(docs, id_column, text_column).mapInArrow(compare, schema)
    named = F.when(F.col("key") != -(2**63), F.col("key")).alias(id_column)
    return compared.select(named, *NAMES[1:])


NAMES = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _pair(key: int, text: str, codes: np.ndarray, other: str, other_codes: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + other[:half]).encode()
    changed = _codes(edited)
    return (
        key, len(text), hashlib.sha256(edited).hexdigest(), _digest(codes), _digest(changed),
        _alike(codes, changed), _alike(codes, other_codes),
    )
