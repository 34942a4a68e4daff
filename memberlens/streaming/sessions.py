"""Idle-timeout sessions on event streams, in whatever order events come.

A session is a chain of events with no pause longer than the idle limit. Its events may be folded to intervals
in any grouping: intervals with no longer pause between them belong together, whenever they were found. The
stream keeps the open intervals of each key and emits an interval once the newest time of its bucket has
left it behind. A late event opens an interval of its own or joins an open one; if it belongs to one
already emitted, it is emitted as a correction beside it, and ``joined`` puts the two together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from memberlens.functions.clock import micros
from memberlens.operators.sessions import IDLE_LIMIT
from memberlens.streaming.buckets import HASHES, LATENESS, dealt, decided, horizon, state_of, time_like

_TIMES = ["low", "high", "events"]


def merged(
    group: np.ndarray, low: np.ndarray, high: np.ndarray, events: np.ndarray, idle: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first, low, high, events) of the intervals that stay apart; sorted by group and low."""
    if not len(group):
        return np.empty(0, np.int64), low, high, events
    reach = pd.Series(high).groupby(group).cummax().to_numpy()
    starts = np.ones(len(group), bool)
    starts[1:] = (group[1:] != group[:-1]) | (low[1:] - reach[:-1] > idle)
    first = np.flatnonzero(starts)
    return first, low[first], np.maximum.reduceat(high, first), np.add.reduceat(events, first)


def _fold_bucket(
    keys: list[str], idle: int, lateness: timedelta
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, clock = state.get if state.exists else (*([] for _ in range(len(keys) + 5)), None)
        names = [*keys, *HASHES, *_TIMES]
        given = list(batches)
        fresh = pd.concat(given, ignore_index=True)
        fresh = fresh.assign(low=fresh["_us"], high=fresh["_us"], events=1)[names]
        columns = {
            name: np.concatenate([np.array(old, dtype=object if name in keys else np.int64), fresh[name].to_numpy(object if name in keys else np.int64)])
            for name, old in zip(names, held, strict=True)
        }
        order = np.lexsort((columns["low"], columns["_second"], columns["_first"]))
        columns = {name: values[order] for name, values in columns.items()}
        other = np.ones(len(order), bool)
        for name in HASHES:
            other[1:] &= columns[name][1:] == columns[name][:-1]
        other[1:] = ~other[1:]
        first, low, high, events = merged(np.cumsum(other), *(columns[n] for n in _TIMES), idle)
        columns = {name: columns[name][first] for name in [*keys, *HASHES]} | {"low": low, "high": high, "events": events}
        clock = int(high.max()) if clock is None else max(clock, int(high.max()))
        closed = high + idle < horizon(clock, lateness)
        state.update((*(columns[name][~closed].tolist() for name in names), clock))
        yield pd.DataFrame({name: columns[name][closed] for name in [*keys, *_TIMES]})

    return run


def session_fragments(
    events: DataFrame,
    keys: list[str],
    ts: str,
    idle: timedelta = IDLE_LIMIT,
    lateness: timedelta = LATENESS,
    buckets: int | None = None,
) -> DataFrame:
    """(keys, low, high, events) of every interval left behind: microseconds of first and last event, and count.

    No row is dropped but those without a time. The state holds the intervals that ended less than ``idle`` and
    ``lateness`` before the newest event of their bucket.
    """
    # keys travel as texts, in which a missing whole number stays one
    texts = [T.StructField(key, T.StringType()) for key in keys]
    longs = [T.StructField(name, T.LongType()) for name in _TIMES]
    hashes = [T.StructField(name, T.LongType()) for name in HASHES]
    arrays = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in (*texts, *hashes, *longs)]
    state = T.StructType([*arrays, T.StructField("clock", T.LongType())])
    known = events.where(F.col(ts).isNotNull()).select(*(F.col(key).cast("string").alias(key) for key in keys), ts)
    fold = _fold_bucket(keys, micros(idle), lateness)
    found = decided(dealt(known, keys, ts, buckets), fold, T.StructType([*texts, *longs]), state, chained=False)
    return found.select(*(F.col(key).cast(events.schema[key].dataType).alias(key) for key in keys), *_TIMES)


def open_fragments(fragments: DataFrame, checkpoint: str) -> DataFrame:
    """What the stopped stream of ``fragments`` still holds open, read from its state."""
    held = state_of(fragments.sparkSession, checkpoint)
    return held.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fragments.schema))


def joined(
    fragments: DataFrame, keys: list[str], idle: timedelta = IDLE_LIMIT, kind: str = "timestamp_ntz"
) -> DataFrame:
    """(keys, session_start, last_event, event_count): fragments with no longer pause than ``idle`` as one."""
    by_time = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("low") - reach > micros(idle), F.lit(True)).cast("long")
    return (
        fragments.withColumn("_starts", starts).withColumn("_session", F.sum("_starts").over(by_time))
        .groupBy(*keys, "_session")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("events").alias("event_count"))
        .select(*keys, time_like(F.col("low"), kind).alias("session_start"), time_like(F.col("high"), kind).alias("last_event"), "event_count")
    )
