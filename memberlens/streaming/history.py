"""What the assistant still remembers of a thread, message by message.

The stream form of idle timeout and clean-turn truncation together: a message is added to its
thread's history, which starts empty after a pause longer than ``idle`` and is cut to the newest
``max_messages`` at a plain user message whenever it grows beyond them. State is one small entry per
remembered message: its order, time, and whether a history may start there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from memberlens.functions.clock import micros
from memberlens.operators.history import MAX_MESSAGES
from memberlens.operators.sessions import IDLE_LIMIT
from memberlens.streaming.buckets import HASHES, LATENESS, dealt, decided, horizon

_STATE = T.StructType([
    *(
        T.StructField(name, T.ArrayType(T.BooleanType() if name == "clean" else T.LongType()))
        for name in ("first", "second", "place", "clean", "at")
    ),
    T.StructField("clock", T.LongType()),
])


class History:
    """A thread's remembered messages with a queue of those it may be cut at, so that a cut scans nothing."""

    def __init__(self, entries: Iterable[tuple[int, bool, int]] = ()):
        self.kept: deque[tuple[int, bool, int]] = deque(entries)
        self.gone = 0  # messages cut off
        self.cuts = deque(k for k, (_, clean, _) in enumerate(self.kept) if clean)
        self.updated = max((at for *_, at in self.kept), default=None)

    def add(self, place: int, clean: bool, at: int, idle: int, limit: int) -> None:
        if self.updated is not None and at - self.updated > idle:
            self.kept.clear()
            self.cuts.clear()
            self.gone = 0
        if clean:
            self.cuts.append(self.gone + len(self.kept))
        self.kept.append((place, clean, at))
        self.updated = at
        tail = self.gone + len(self.kept) - limit
        if tail > self.gone:
            while self.cuts and self.cuts[0] < tail:  # the tail only moves on
                self.cuts.popleft()
            while self.cuts and self.gone < self.cuts[0]:
                self.kept.popleft()
                self.gone += 1


def _remember(
    columns: list[str], order: str, idle: int, limit: int, lateness: timedelta | None
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, clock = state.get if state.exists else ([], [], [], [], [], None)
        entries: dict[tuple[int, int], list] = {}
        for first, second, *entry in zip(*held, strict=True):
            entries.setdefault((first, second), []).append(tuple(entry))
        threads = {key: History(own) for key, own in entries.items()}
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["_us", order], kind="stable")
        starts, lengths = [], []
        named = rows[[*HASHES, order, "_clean", "_us", "_taken"]].itertuples(index=False, name=None)
        for first, second, place, clean, at, taken in named:
            if not taken:
                starts.append(None)
                lengths.append(None)
                continue
            thread = threads.setdefault((first, second), History())
            thread.add(int(place), bool(clean), at, idle, limit)
            clock = at if clock is None else max(clock, at)
            starts.append(thread.kept[0][0])
            lengths.append(len(thread.kept))
        if clock is not None:
            # after a pause of more than ``idle`` a history starts empty anyway
            until = horizon(clock, lateness)
            flat = [
                (*key, *entry) for key, thread in threads.items()
                if until is None or thread.updated + idle >= until for entry in thread.kept
            ]
            state.update((*(map(list, zip(*flat, strict=True)) if flat else ([], [], [], [], [])), int(clock)))
        out = rows[columns].copy()
        out["history_start"] = pd.array(starts, dtype="Int64")
        out["history_length"] = pd.array(lengths, dtype="Int64")
        yield out

    return run


def remember_stream(
    messages: DataFrame,
    thread: str,
    ts: str,
    order: str,
    is_plain_user: Column,
    idle: timedelta = IDLE_LIMIT,
    max_messages: int = MAX_MESSAGES,
    lateness: timedelta | None = LATENESS,
    taken: Column | None = None,
    buckets: int | None = None,
    chained: bool = False,
) -> DataFrame:
    """Each message with the ``order`` its thread's history starts at, and that history's length.

    ``order`` is a whole number that ranks the messages of a thread. Messages that are not ``taken``, or lack a
    thread or a time, pass through with no history. Histories idle for longer than ``idle`` leave the state
    ``lateness`` after the newest message of their bucket; with None they stay until the thread's next message. ``chained`` operators may follow one another in a query.
    """
    schema = T.StructType([
        *messages.schema.fields, T.StructField("history_start", T.LongType()), T.StructField("history_length", T.LongType()),
    ])
    wanted = F.lit(True) if taken is None else F.coalesce(taken, F.lit(False))
    placed = messages.withColumn("_clean", F.coalesce(is_plain_user, F.lit(False))).withColumn("_wanted", wanted)
    ready = dealt(placed, [thread], ts, buckets).withColumn("_taken", F.col("_wanted") & F.col("_known"))
    remember = _remember(messages.columns, order, micros(idle), max_messages, lateness)
    return decided(ready, remember, schema, _STATE, chained)
