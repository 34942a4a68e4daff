"""Accept at most ``limit`` events per key within a sliding window, rejected ones not counting.

Two rules of the message gateway are this one operator: a rate limit (ten accepted requests per user
and minute) and first-seen de-duplication (one accepted delivery per id, repeats ignored while the
accepted one is at most the time-to-live old).

Every decision depends on earlier decisions of the key, so no window function gives it. But most
events need no history at all. Time is cut into units, eight to the window. An event can only be
affected by its own unit and the eight before; where those hold at most ``limit`` events together,
every event of the unit is accepted. Only runs of crowded units are decided in sequence, starting
from the calm units before the run, whose events are known to be accepted.

What is shuffled: counts per key and unit, pre-aggregated in each task, and the events of crowded
runs. A run is cut into chunks of at most ``chunk_rows`` events; a unit with more is cut into ever finer
cells of time, down to one microsecond, of whose events no more than ``limit`` can be accepted. The runs of
all keys go in parallel, one chunk of each in a round. The accepted events still alive after a chunk tell
when the next one can be accepted; chunks that end before are refused without being read. So
a hot key takes rounds for what it accepts, not for what it sends, and no task holds a whole key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.clock import micros, micros_of
from memberlens.operators.lookup import top_per_key
from memberlens.session import stage

# Fixed values of the message gateway.
SEEN_TTL = timedelta(minutes=5)
RATE_WINDOW = timedelta(seconds=60)
RATE_LIMIT = 10

UNITS_PER_WINDOW = 8
CELLS_PER_CELL = 64
CHUNK_ROWS = 10_000_000


def _lengths(unit: int) -> list[int]:
    """Lengths of cells, level by level, from a whole unit to one microsecond."""
    lengths = [unit]
    while lengths[-1] > 1:
        lengths.append(-(-lengths[-1] // CELLS_PER_CELL))
    return lengths


def _cell(lengths: list[int], level: int) -> Column:
    """Start of the cell of a row at ``level``."""
    cell = F.col("_unit") * lengths[0]
    for length in lengths[1 : level + 1]:
        cell = cell + F.floor((F.col("_us") - cell) / length).cast("long") * length
    return cell


def _crowded_runs(
    events: DataFrame, keys: list[str], limit: int, chunk_rows: int, lengths: list[int]
) -> DataFrame:
    """Cells to decide in sequence with their run and chunk, led by the calm units before each run.

    The windows per key run over counted units and cells, so their length is bounded by elapsed time and by
    the number of chunks.
    """
    counts = events.groupBy(*keys, "_unit").agg(F.count("*").alias("_n"))
    by_time = Window.partitionBy(*keys).orderBy("_unit")
    behind = by_time.rangeBetween(-UNITS_PER_WINDOW, Window.currentRow)
    ahead = by_time.rangeBetween(Window.currentRow, UNITS_PER_WINDOW)
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    crowded_unit = F.when(F.col("_crowded"), F.col("_unit"))
    pause = F.col("_unit") - F.last(crowded_unit, ignorenulls=True).over(earlier)
    starts = F.col("_crowded") & F.coalesce(pause > UNITS_PER_WINDOW, F.lit(True))
    # a calm unit takes part when a crowded one follows within a window, and joins that one's run
    next_crowded = F.first(crowded_unit, ignorenulls=True).over(ahead)
    next_starts = F.first(F.when(F.col("_crowded"), F.col("_starts")), ignorenulls=True).over(ahead)
    last_start = F.last(F.when(F.col("_starts"), F.col("_unit")), ignorenulls=True).over(up_to_here)
    members = (
        counts.withColumn("_crowded", F.sum("_n").over(behind) > limit)
        .withColumn("_starts", starts)
        .withColumn("_run", F.when(next_starts, next_crowded).when(~next_starts, last_start))
        .where(F.col("_run").isNotNull())
    )
    most = max(chunk_rows // 2, 1)
    columns = [*keys, "_unit", "_crowded", "_run", "_cell", "_n", F.lit(0).alias("_level")]
    cells = stage(members.withColumn("_cell", F.col("_unit") * lengths[0]).select(*columns))
    done = []
    for level in range(1, len(lengths)):
        large = cells.where(F.col("_n") > most)
        if large.isEmpty():
            break
        done.append(cells.where(F.col("_n") <= most))
        inside = events.withColumn("_cell", _cell(lengths, level - 1)).join(
            large.drop("_n", "_level"), [*keys, "_unit", "_cell"]
        )
        finer = inside.withColumn("_cell", _cell(lengths, level)).groupBy(*columns[:5]).agg(F.count("*").alias("_n"))
        cells = stage(finer.withColumn("_level", F.lit(level)))
    # of one microsecond no more can be accepted
    cells = cells.withColumn("_n", F.when(F.col("_level") == len(lengths) - 1, F.least("_n", F.lit(limit))).otherwise(F.col("_n")))
    cells = reduce(DataFrame.unionByName, [*done, cells])
    by_run = Window.partitionBy(*keys, "_run").orderBy("_cell")
    rows_before = F.sum("_n").over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    slice_number = F.floor(F.coalesce(rows_before, F.lit(0)) / most)
    by_slice = Window.partitionBy(*keys, "_run").orderBy("_slice")
    return cells.withColumn("_slice", slice_number).select(
        *keys, "_unit", "_crowded", "_run", "_cell", "_level", "_n",
        (F.dense_rank().over(by_slice) - 1).cast("long").alias("_chunk"),
    )


def _accept_in_order(
    group: list[str], limit: int, span: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Accepted rows of a partition sorted by ``group`` and time.

    Only the accepted times that still count are kept, so memory does not depend on the length of a
    group. After a rejection it jumps to the first time at which the oldest accepted event has
    expired: the work grows with accepted events, not with rejected ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alive: deque[int] = deque(maxlen=limit)  # when full, a new entry drops the oldest
        last = None
        for rows in batches:
            if not len(rows):
                continue
            fresh = np.zeros(len(rows), dtype=bool)
            for name in group:
                values = rows[name].to_numpy()
                fresh[1:] |= values[1:] != values[:-1]
            first, newest = rows[group].iloc[[0, -1]].itertuples(index=False, name=None)
            fresh[0] = first != last
            last = newest
            times = rows["_us"].tolist()
            edges = [0, *np.flatnonzero(fresh[1:]) + 1, len(rows)]
            kept = []
            for at, end in zip(edges, edges[1:]):
                if fresh[at]:
                    alive.clear()
                while at < end:
                    if len(alive) == limit and times[at] - alive[0] < span:
                        at = bisect_left(times, alive[0] + span, at + 1, end)
                    else:
                        kept.append(at)
                        alive.append(times[at])
                        at += 1
            yield rows.iloc[kept]

    return run


def _accepted_in_runs(
    timed: DataFrame, runs: DataFrame, keys: list[str], limit: int, span: int, lengths: list[int]
) -> DataFrame | None:
    """Keys, time and order of the accepted events of crowded runs; None without any run."""
    last_level, last_chunk = runs.agg(F.max("_level"), F.max("_chunk")).first()
    if last_chunk is None:
        return None
    group = [*keys, "_run"]
    columns = [*group, "_order", "_us", "_carried"]
    by_level = []
    for level in range(last_level + 1):
        own = runs.where(F.col("_level") == level).select(*group, "_unit", "_cell", "_chunk")
        rows = timed.withColumn("_cell", _cell(lengths, level)).join(own, [*keys, "_unit", "_cell"])
        if lengths[level] == 1:
            rows = top_per_key(rows, [*keys, "_us"], [F.asc("_order")], limit)
        by_level.append(rows.withColumn("_carried", F.lit(False)).select(*columns, "_chunk"))
    rows = reduce(DataFrame.unionByName, by_level)
    if last_chunk:
        rows = stage(rows, partition_by="_chunk")
    length = F.element_at(F.array(*map(F.lit, lengths)), F.col("_level") + 1)
    chunks = runs.groupBy(*group, "_chunk").agg(F.max(F.col("_cell") + length).alias("_until"))
    accept = _accept_in_order(group, limit, span)
    results, carried = [], None
    following = chunks.where("_chunk = 0").select(*group, "_chunk")
    numbers = [0]
    while numbers:
        now = rows.where(F.col("_chunk").isin(numbers))
        if last_chunk:
            now = now.join(following, [*group, "_chunk"], "left_semi")
        now = now.select(*columns)
        if carried is not None:
            # runs that go on start from their last accepted events
            now = now.unionByName(carried.join(following.select(*group), group, "left_semi"))
        ordered = now.repartition(*group).sortWithinPartitions(*group, "_us", "_order")
        result = stage(ordered.mapInPandas(accept, ordered.schema))
        results.append(result.where(~F.col("_carried")).select(*keys, "_us", "_order"))
        if not last_chunk:
            break
        carried = top_per_key(
            result.withColumn("_carried", F.lit(True)),
            group, [F.desc("_us"), F.desc("_order")], limit,
        ).select(*columns)
        # the next chunk in which something can be accepted, once the oldest of a full set has run out
        free = carried.groupBy(*group).agg(
            F.when(F.count("*") == limit, F.min("_us") + span).alias("_free")
        )
        ahead = (
            chunks.join(following.withColumnRenamed("_chunk", "_done"), group).join(free, group, "left")
            .where("_chunk > _done AND (_free IS NULL OR _until > _free)")
        )
        following = stage(ahead.groupBy(*group).agg(F.min("_chunk").alias("_chunk")))
        numbers = [r[0] for r in following.select("_chunk").distinct().collect()]
    return reduce(DataFrame.unionByName, results)


def admit(
    events: DataFrame,
    keys: list[str],
    ts: str,
    order: str,
    limit: int,
    window: timedelta,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``events`` with a boolean ``accepted``.

    An accepted event counts while strictly less than ``window`` old. ``order`` decides between equal
    times of a key; of events equal in that too, as many are accepted as the limit leaves room for.
    Events without a key or a time are accepted.

    The crowded runs and the events accepted in them are staged, so calling this starts jobs. Only events
    of crowded units are shuffled; calm ones are told apart by a join with the few crowded units.
    ``chunk_rows`` only changes how the work is cut, never the result.
    """
    span = micros(window)
    unit = -(-span // UNITS_PER_WINDOW)
    timed = events.withColumns({"_us": micros_of(events, ts), "_order": F.col(order)})
    timed = timed.withColumn("_unit", F.floor(F.col("_us") / unit).cast("long"))
    present = F.col("_us").isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    lengths = _lengths(unit)
    runs = stage(_crowded_runs(timed.where(present), keys, limit, chunk_rows, lengths))
    kept = _accepted_in_runs(timed, runs, keys, limit, span, lengths)
    if kept is None:
        return events.withColumn("accepted", F.lit(True))
    # equal (key, time, order) have no identity of their own: as many of them pass as were accepted
    crowded = runs.where("_crowded").select(*keys, "_unit").distinct()
    same = [*keys, "_us", "_order"]
    passed = kept.groupBy(*same).agg(F.count("*").alias("_passed"))
    copies = Window.partitionBy(*same).orderBy("_order")
    decided = (
        timed.join(crowded, [*keys, "_unit"], "left_semi")
        .withColumn("_copy", F.row_number().over(copies))
        .join(passed, same, "left")
        .withColumn("accepted", F.coalesce(F.col("_copy") <= F.col("_passed"), F.lit(False)))
    )
    calm = timed.join(crowded, [*keys, "_unit"], "left_anti").withColumn("accepted", F.lit(True))
    columns = [*events.columns, "accepted"]
    return calm.select(*columns).unionByName(decided.select(*columns))


def mark_duplicates(
    events: DataFrame, keys: list[str], ts: str, order: str, ttl: timedelta = SEEN_TTL, **options
) -> DataFrame:
    """``is_duplicate`` is true while the accepted delivery of the same key is at most ``ttl`` old.

    A duplicate does not extend the time.
    """
    inclusive = ttl + timedelta(microseconds=1)
    marked = admit(events, keys, ts, order, 1, inclusive, **options)
    return marked.withColumn("is_duplicate", ~F.col("accepted")).drop("accepted")


def mark_rate_limited(
    events: DataFrame,
    keys: list[str],
    ts: str,
    order: str,
    limit: int = RATE_LIMIT,
    window: timedelta = RATE_WINDOW,
    **options,
) -> DataFrame:
    """``is_limited`` is true when ``limit`` requests of the key were accepted within ``window``."""
    marked = admit(events, keys, ts, order, limit, window, **options)
    return marked.withColumn("is_limited", ~F.col("accepted")).drop("accepted")
