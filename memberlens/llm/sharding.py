"""Sharding by histogram sort: splitters are probed with exact byte counts, then rows move once.

Rows are ordered by a 64-bit key made from their text and id: equal texts stand side by side, so a
group of copies stays in one shard unless a splitter has to cut it, and the id spreads them, so that
a group of any size can be cut where the bytes ask for it. Rows alike in text and id would share a key; if
together they are too large for the tolerance, they are numbered, and the number takes the id's place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memberlens.llm.common import id_order, map_batches
from memberlens.session import stage

#: candidate boundaries probed for each splitter in a round
PROBES = 32
#: accepted distance of a splitter from its exact place, as a share of a shard's bytes
TOLERANCE = 0.001
#: rows that are numbered together
CELL_ROWS = 10_000
_LOW, _HIGH = -(2**63), 2**63 - 1
_ID_BITS = 24


def order_key(text, doc_id) -> F.Column:
    """The sort key: 40 bits of the text's hash, then 24 bits of the id's."""
    low = (1 << _ID_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(low)))


def byte_size(text) -> F.Column:
    """UTF-8 bytes plus one; a missing text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _numbered(keyed: DataFrame, sized: DataFrame, least: float) -> DataFrame:
    """``keyed`` with keys of their own for the rows of each repeated key of more than ``least`` bytes.

    There are at most as many such keys as the table has ``least`` bytes. Their rows are written
    once with their numbers, so that every later reading, also after a lost executor, sees the same.
    """
    repeated = sized.groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    large = [r.key for r in repeated.where((F.col("rows") > 1) & (F.col("bytes") > F.lit(least))).select("key").collect()]
    if not large:
        return keyed
    is_large = F.col("_key").isin(large)
    own = stage(keyed.where(is_large).withColumn("_repeat", F.monotonically_increasing_id()))
    low = (1 << _ID_BITS) - 1
    number = F.xxhash64("_repeat").bitwiseAND(F.lit(low))
    own = own.withColumn("_key", F.col("_key").bitwiseAND(F.lit(~low)).bitwiseOR(number)).drop("_repeat")
    return keyed.where(~is_large).unionByName(own)


def splitters(sized: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """``shards - 1`` keys; rows with a key below the first go to shard 0, and so on.

    ``sized`` has ``key`` and ``size``. Every round counts, over all rows, the bytes below each probe;
    the driver receives one sum for each probe. A splitter is settled when the bytes below it are within
    ``tolerance`` of a shard, or when no other key is left.
    """
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * k / shards for k in range(1, shards)]
    # below `low` there are too few bytes, below `high` enough
    spans = [[_LOW, 0, _HIGH, total] for _ in targets]

    def settled(span: list[int], target: float) -> bool:
        low, below, high, above = span
        return high - low <= 1 or min(abs(target - below), abs(above - target)) <= tolerance * total / shards

    while True:
        probes = sorted({
            low + (high - low) * j // (PROBES + 1)
            for (low, b, high, a), t in zip(spans, targets, strict=True) if not settled([low, b, high, a], t)
            for j in range(1, PROBES + 1)
        } - {s[0] for s in spans} - {s[2] for s in spans})
        if not probes:
            break
        sums = _bytes_by_cell(sized, probes)
        below = np.cumsum(sums[:-1])
        for span, target in zip(spans, targets, strict=True):
            for probe, bytes_below in zip(probes, below, strict=True):
                if span[0] < probe < span[2]:
                    if bytes_below < target:
                        span[0], span[1] = probe, int(bytes_below)
                    else:
                        span[2], span[3] = probe, int(bytes_below)
                        break
    return [
        low if abs(target - below) < abs(above - target) else high
        for (low, below, high, above), target in zip(spans, targets, strict=True)
    ]


def _bytes_by_cell(sized: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes between neighbouring probes, over all partitions."""
    edges = np.array(probes, np.int64)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = np.searchsorted(edges, batch.column("key").to_numpy(), "right")
        order = np.argsort(cells, kind="stable")
        sizes = batch.column("size").to_numpy()[order]
        found, starts = np.unique(cells[order], return_index=True)
        return pa.record_batch({"cell": pa.array(found), "size": pa.array(np.add.reduceat(sizes, starts))})

    summed = map_batches(sized, of, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size"))
    result = [0] * (len(edges) + 1)
    for cell, size in summed.collect():  # one row for each probe at most
        result[cell] = size
    return result


def shard_rows(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    The law is `bytes`: shards are equal in the sum of sizes but for the tolerance and for one row at
    each splitter. All columns move in one exchange. Rows are numbered in cells of about ``cell_rows``
    rows, whose first numbers are prefix sums of the cells' counts. A missing text has size 1; a missing
    id is an id like others; rows alike in id and text are spread like others; an empty table
    stays empty. Columns of the same names are replaced.
    """
    named = docs.drop("size", "shard", "slot").columns
    text, doc_id = (F.col("row").getField(c) for c in (text_column, id_column))
    # a struct holds the columns, so that none can clash with those added here
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in named)).alias("row")).withColumns({
        "size": byte_size(text), "_key": order_key(text, doc_id),
    })
    sized = stage(keyed.select(F.col("_key").alias("key"), "size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    spread = _numbered(keyed, sized, TOLERANCE * total / shards)
    if spread is not keyed:
        keyed, sized = spread, stage(spread.select(F.col("_key").alias("key"), "size"))
    bounds = splitters(sized, shards)
    rows = sized.count()
    cells = max(1, math.ceil(rows / (shards * cell_rows)))

    def placed(frame: DataFrame, key: str) -> DataFrame:
        shard = sum((F.when(F.col(key) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
        return frame.withColumns({
            "shard": shard.cast("int"), "_cell": F.pmod(F.xxhash64(key), F.lit(cells)).cast("int"),
        })

    counts = placed(sized, "key").groupBy("shard", "_cell").agg(F.count("*").alias("rows"))
    earlier = W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(
        "shard", "_cell", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_base")
    )
    bases = stage(bases)
    within = W.partitionBy("shard", "_cell").orderBy("_key", id_order(doc_id))
    return (
        placed(keyed, "_key")
        .withColumn("_row", F.row_number().over(within) - 1)
        .join(bases, ["shard", "_cell"])
        .withColumn("slot", (F.col("_base") + F.col("_row")).cast("long"))
        .select("row.*", "size", "shard", "slot")
    )
