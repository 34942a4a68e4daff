"""De-duplication and rate limiting on event streams, one state for many keys.

The rules are those of :mod:`memberlens.operators.admission`, the state is that of
:mod:`memberlens.streaming.buckets`: the accepted times that still count. Most keys of a bucket are decided in one
vectorised pass, the few that come near their limit one after another.

Rows of a key are put in order within each micro-batch, whose size the source bounds
(``read_event_stream`` does so by itself); a row that arrives in a later micro-batch with an earlier time is
decided against the state as it then is, and decisions already made stay.
``dropDuplicatesWithinWatermark`` would not do: there a duplicate is measured against the watermark, not
against the accepted delivery.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from memberlens.functions.clock import micros
from memberlens.operators.admission import RATE_LIMIT, RATE_WINDOW, SEEN_TTL
from memberlens.streaming.buckets import HASHES, LATENESS, dealt, decided, horizon, places

#: one entry for each accepted time: 128 bits of the key's hash and the time
_STATE = T.StructType([
    *(T.StructField(name, T.ArrayType(T.LongType())) for name in ("first", "second", "at")), T.StructField("clock", T.LongType()),
])


def _in_turn(times: list[int], alive: list[int], limit: int, span: int) -> list[int]:
    """Places of the accepted of ascending ``times``, after those accepted before; any of these counts."""
    kept, at = [], 0
    while at < len(times):
        now = times[at]
        alive = [then for then in alive if now - then < span]
        if len(alive) < limit:
            alive.append(now)
            kept.append(at)
            at += 1
        else:  # nothing is accepted until as many have run out that the limit leaves room
            free = sorted(alive)[len(alive) - limit] + span
            at = bisect_left(times, free, at + 1)
    return kept


def decide(group: np.ndarray, times: np.ndarray, old: np.ndarray, limit: int, span: int) -> np.ndarray:
    """Which rows are accepted; rows come by group, the ``old`` ones (accepted before) first, then by time.

    A row with fewer than ``limit`` rows of its group less than ``span`` before it is accepted whatever happens
    to those. Only groups with another row are gone through in turn.
    """
    n = len(group)
    accepted = np.ones(n, bool)
    if n <= 1:
        return accepted
    near = np.zeros(n, bool)
    if n > limit:
        near[limit:] = (group[limit:] == group[:-limit]) & (times[limit:] - times[:-limit] < span)
    # a row before an accepted one of an earlier micro-batch
    disordered = np.zeros(n, bool)
    disordered[1:] = (group[1:] == group[:-1]) & (times[1:] < times[:-1]) & ~old[1:]
    crowded = np.unique(group[(near | disordered) & ~old])
    starts, ends = np.searchsorted(group, crowded), np.searchsorted(group, crowded, "right")
    for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
        new = low + int(old[low:high].sum())
        accepted[new:high] = False
        kept = _in_turn(times[new:high].tolist(), times[low:new].tolist(), limit, span)
        accepted[new + np.array(kept, np.int64)] = True
    return accepted


def _decide_bucket(
    columns: list[str], order: str, flag: str, limit: int, span: int, lateness: timedelta | None
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = list(batches)
        rows = given[0] if len(given) == 1 else pd.concat(given, ignore_index=True)
        known = rows["_known"].to_numpy(bool)
        *held, clock = state.get if state.exists else ([], [], [], None)
        held = [np.asarray(a, np.int64) for a in held]
        fresh = rows.loc[known, [*HASHES, "_us"]].to_numpy(np.int64)
        first, second, at = (np.concatenate([a, b]) for a, b in zip(held, fresh.T, strict=True))
        n_held = len(held[0])
        old = np.arange(len(at)) < n_held
        place = np.concatenate([np.zeros(n_held, np.int64), places(rows.loc[known, order])])
        in_order = np.lexsort((place, at, ~old, second, first))
        first, second, at, old = first[in_order], second[in_order], at[in_order], old[in_order]
        other = np.ones(len(at), bool)
        other[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.cumsum(other)
        accepted = decide(group, at, old, limit, span)

        refused = np.zeros(len(rows), bool)
        source = np.flatnonzero(known)
        new = np.flatnonzero(~old)
        refused[source[in_order[new] - n_held]] = ~accepted[new]
        if len(at):
            clock = max(int(at.max()), at.min() if clock is None else clock)
            # the newest accepted ones of each key, as many as the limit counts
            keep = np.flatnonzero(accepted)
            keep = keep[np.lexsort((at[keep], group[keep]))]
            from_end = np.searchsorted(group[keep], group[keep], "right") - np.arange(len(keep))
            keep = keep[from_end <= limit]
            if lateness is not None:
                # an accepted time that has run out changes no decision any more
                keep = keep[at[keep] + span > horizon(clock, lateness)]
            state.update((*(a[keep].tolist() for a in (first, second, at)), int(clock)))
        yield rows[columns].assign(**{flag: refused})

    return run


def refuse_stream(
    events: DataFrame,
    keys: list[str],
    ts: str,
    order: str,
    limit: int,
    window: timedelta,
    flag: str,
    lateness: timedelta | None = LATENESS,
    buckets: int | None = None,
    chained: bool = False,
) -> DataFrame:
    """The stream with a boolean ``flag`` on refused rows.

    No row is dropped. Accepted times leave the state once they have run out ``lateness`` before the newest
    row of their bucket; a row that comes later than that is decided by what is left. With None the last
    accepted times of every key stay. Rows without a key or a time are accepted. Keys are told apart by
    128 bits of hash. ``chained`` operators may follow one another in a query.
    """
    schema = T.StructType([*events.schema.fields, T.StructField(flag, T.BooleanType())])
    run = _decide_bucket(events.columns, order, flag, limit, micros(window), lateness)
    return decided(dealt(events, keys, ts, buckets), run, schema, _STATE, chained)


def mark_duplicates_stream(
    events: DataFrame, keys: list[str], ts: str, order: str, ttl: timedelta = SEEN_TTL, **options
) -> DataFrame:
    """``is_duplicate`` while the accepted delivery of the key is at most ``ttl`` old."""
    inclusive = ttl + timedelta(microseconds=1)
    return refuse_stream(events, keys, ts, order, 1, inclusive, "is_duplicate", **options)


def mark_rate_limited_stream(
    events: DataFrame,
    keys: list[str],
    ts: str,
    order: str,
    limit: int = RATE_LIMIT,
    window: timedelta = RATE_WINDOW,
    **options,
) -> DataFrame:
    """``is_limited`` when ``limit`` requests of the key were accepted within ``window``."""
    return refuse_stream(events, keys, ts, order, limit, window, "is_limited", **options)
