"""State of many keys in one: a fixed number of buckets, each with flat arrays of small entries.

A call of Python for each key and each eviction is what makes keyed streams slow; with buckets a
micro-batch costs a call for each bucket, and whole buckets are decided and evicted by array operations. Time is
the newest event time a bucket has seen, so no row is ever dropped and operators can follow one another in
one query (``decided``). What lies further behind that time than ``LATENESS`` beyond its use is dropped from the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from memberlens.functions.clock import micros_of
from memberlens.session import ensure_state_on_disk

#: how far behind the newest row a row may come and still meet all that concerns it
LATENESS = timedelta(hours=1)
#: buckets for each shuffle partition; like that number, fixed for as long as a checkpoint is used
BUCKETS = 16
#: 128 bits of the hash of a key
HASHES = ["_first", "_second"]


def dealt(frame: DataFrame, keys: list[str], ts: str, buckets: int | None = None) -> DataFrame:
    """``frame`` with ``_us``, ``_known`` (key and time are there), the key's hashes and ``_bucket``."""
    buckets = buckets or BUCKETS * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    us = micros_of(frame, ts)
    known = us.isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    gaps = [F.col(key).isNull() for key in keys]  # a hash passes over missing values
    hashed = frame.withColumns({
        "_us": F.coalesce(us, F.lit(0)), "_known": known,
        "_first": F.xxhash64(*keys, *gaps), "_second": F.xxhash64(F.lit(1), *keys, *gaps),
    })
    return hashed.withColumn("_bucket", F.pmod(F.col("_first"), F.lit(buckets)))


#: decides the rows of a bucket: (bucket, batches, state) to batches; the state has ``exists``, ``get`` and ``update``
Decide = Callable[[tuple, Iterator[pd.DataFrame], object], Iterator[pd.DataFrame]]


class _State:
    """A value state with the face of a group state."""

    def __init__(self, value):
        self.value, self.exists, self.update = value, value.exists(), value.update

    @property
    def get(self) -> tuple:
        return self.value.get()


class _Chained(StatefulProcessor):
    def __init__(self, decide: Decide, kept: T.StructType, columns: list[str]):
        self.decide, self.kept, self.columns = decide, kept, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("kept", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # the rows' way through named tuples loses names with a leading underscore
        named = (batch.set_axis(self.columns, axis=1) for batch in rows)
        yield from self.decide(key, named, _State(self.value))

    def close(self) -> None:
        pass


def decided(frame: DataFrame, decide: Decide, schema: T.StructType, kept: T.StructType, chained: bool) -> DataFrame:
    """``decide`` over the buckets of a ``dealt`` frame, with a state of the type ``kept`` for each.

    Spark lets one such operator into a query, unless it is ``chained``: that form follows others of its kind,
    and asks a state server of the executor for the state (it needs protobuf in the Python workers, and a store
    with several tables, which the session is given if it has Spark's own).
    """
    buckets = frame.groupBy("_bucket")
    if chained:
        ensure_state_on_disk(frame.sparkSession)
        return buckets.transformWithStateInPandas(_Chained(decide, kept, frame.columns), schema, "append", "none")
    return buckets.applyInPandasWithState(decide, schema, kept, "append", GroupStateTimeout.NoTimeout)


def places(values: pd.Series) -> np.ndarray:
    """Ranks of an order column of numbers or texts; missing ones first."""
    return pd.factorize(values, sort=True)[0]


def horizon(clock: int, lateness: timedelta | None) -> int | None:
    """The time before which the state holds nothing; None: it holds everything."""
    return None if lateness is None else clock - lateness // timedelta(microseconds=1)


def state_of(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The entries an operator of a stopped stream still keeps, one row each, without the bucket's clock."""
    held = (
        spark.read.format("statestore").option("operatorId", operator).load(f"{checkpoint}/progress")
        .select("value.groupState.*")
    )
    arrays = [f.name for f in held.schema if f.dataType.typeName() == "array"]
    return held.select(F.explode(F.arrays_zip(*arrays)).alias("entry")).select("entry.*")


def time_like(us: Column, kind: str) -> Column:
    """Microseconds as a time of the type ``kind``; local times stand in no zone."""
    if kind == "timestamp_ntz":
        epoch = F.to_timestamp_ntz(F.lit("1970-01-01"))
        return F.timestamp_add("MICROSECOND", us, epoch)
    return F.timestamp_micros(us)
