"""Streams decide as the batch jobs do when files arrive in time order."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from memberlens.operators.admission import mark_duplicates, mark_rate_limited
from memberlens.operators.sessions import sessions
from memberlens.sources import messages as message_files
from memberlens.sources.messages import MESSAGE_SCHEMA, read_event_stream, read_message_stream
from memberlens.streaming.admission import decide, mark_duplicates_stream, mark_rate_limited_stream
from memberlens.streaming.buckets import BUCKETS
from memberlens.streaming.history import remember_stream
from memberlens.streaming.messages import direct_questions, mentions
from memberlens.streaming.run import process_available
from memberlens.streaming.sessions import joined, open_fragments, session_fragments

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type"
    )


def write_in_order(events, folder, parts=4):
    """One file per part, oldest first."""
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // parts + 1
    for part in range(parts):
        start = low + part * step
        piece = events.where((F.col("event_id") >= start) & (F.col("event_id") < start + step))
        piece.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


@pytest.fixture(scope="module")
def event_files(events, tmp_path_factory):
    return write_in_order(events, tmp_path_factory.mktemp("events"))


def drain(stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return query


def stream_of(spark, events, folder):
    return read_event_stream(spark, folder, events.schema, maxFilesPerTrigger="1")


@pytest.mark.parametrize("lateness", [None, timedelta(hours=1)])
def test_rate_limit_stream_equals_batch(spark, events, event_files, tmp_path, lateness):
    name = "limited_late" if lateness else "limited"
    stream = mark_rate_limited_stream(
        stream_of(spark, events, event_files), ["user_id"], "ts", "event_id", 3, DAY,
        lateness=lateness,
    )
    drain(stream, name, tmp_path)
    batch = mark_rate_limited(events, ["user_id"], "ts", "event_id", 3, DAY)
    got = sorted(map(tuple, spark.table(name).select("event_id", "is_limited").collect()))
    assert got == sorted(map(tuple, batch.select("event_id", "is_limited").collect()))
    assert sum(flag for _, flag in got) > 0


def test_duplicate_stream_equals_batch(spark, events, event_files, tmp_path):
    keys = ["user_id", "event_type"]
    stream = mark_duplicates_stream(
        stream_of(spark, events, event_files), keys, "ts", "event_id", DAY
    )
    drain(stream, "duplicates", tmp_path)
    batch = mark_duplicates(events, keys, "ts", "event_id", DAY)
    got = sorted(map(tuple, spark.table("duplicates").select("event_id", "is_duplicate").collect()))
    assert got == sorted(map(tuple, batch.select("event_id", "is_duplicate").collect()))


SESSION = ["user_id", "session_start", "last_event", "event_count"]


def test_sessions_take_files_in_any_order(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(message_files, "_BOUNDED", {"maxFilesPerTrigger": "1"})
    events = spark.read.parquet(f"{small}/events.parquet")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - low) * 4 / (high - low + 1))
    for own in (3, 0, 2, 1):
        events.where(part == own).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = entries.queries()["e03_sessions_stream"](spark, str(tmp_path)).select(*SESSION).collect()
    want = sessions(events, ["user_id"], "ts").select(*SESSION).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(got) > 900


def test_open_sessions_are_all_a_session_stream_keeps(spark, events, event_files, tmp_path):
    """In order of time, with corrections of late rows, missing keys and times."""
    day = events.withColumn("user_id", F.when(F.col("user_id") % 7 > 0, F.col("user_id")))
    extra = [(-1, None, 5, "x"), (-2, datetime(2020, 1, 1), 2**60 + 1, "x"), (-3, datetime(2020, 1, 1, 0, 30), 2**60 + 1, "x")]
    folder = write_in_order(day, tmp_path / "events")
    late = spark.createDataFrame(extra, events.schema)
    late.coalesce(1).write.mode("append").parquet(folder)
    for bridge in (29, 31):  # one event joins the session that was closed before, one does not
        at = datetime(2020, 1, 1, 1, 0) + timedelta(minutes=bridge - 29 + (bridge > 29) * 30)
        spark.createDataFrame([(-9, at, 2**60 + 1, "x")], events.schema).coalesce(1).write.mode("append").parquet(folder)
    home = str(tmp_path / "home")
    lateness, idle = timedelta(minutes=10), timedelta(minutes=30)
    fragments = session_fragments(stream_of(spark, events, folder), ["user_id"], "ts", idle, lateness)
    closed = process_available(fragments, home)
    still = open_fragments(closed, home)
    everything = spark.read.schema(events.schema).parquet(folder)
    got = joined(closed.unionByName(still), ["user_id"]).select(*SESSION).collect()
    want = sessions(everything, ["user_id"], "ts").select(*SESSION).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.session_start for r in got if r.user_id == 2**60 + 1} == {datetime(2020, 1, 1), datetime(2020, 1, 1, 1, 32)}
    total, kept = closed.count() + still.count(), still.count()
    assert 0 < kept <= BUCKETS * 4 and total > 5 * kept


def test_states_keep_what_still_counts(spark, events, event_files, tmp_path):
    """Accepted times leave the state; its rows are the buckets, whatever the number of keys."""
    home, span, lateness = str(tmp_path / "home"), timedelta(hours=2), timedelta(minutes=5)
    stream = mark_rate_limited_stream(
        stream_of(spark, events, event_files), ["user_id"], "ts", "event_id", 2, span, lateness=lateness, buckets=8
    )
    result = process_available(stream, home)
    batch = mark_rate_limited(events, ["user_id"], "ts", "event_id", 2, span)
    assert sorted(map(tuple, result.select("event_id", "is_limited").collect())) == sorted(
        map(tuple, batch.select("event_id", "is_limited").collect())
    )
    held = spark.read.format("statestore").load(f"{home}/progress").select("value.groupState.*").collect()
    assert 1 < len(held) <= 8
    oldest = [r.clock - min(r["at"]) for r in held if r["at"]]
    assert max(oldest) < (span + lateness) // timedelta(microseconds=1)
    assert sum(len(r["at"]) for r in held) < events.count() / 20


def test_rows_without_key_or_time_are_not_limited(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(1, None, at), (2, None, at), (3, "a", None), (4, "a", None), (5, "a", at), (6, "a", at)]
    frame = spark.createDataFrame(rows, "event_id long, user string, ts timestamp_ntz")
    frame.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = read_event_stream(spark, str(tmp_path / "events"), frame.schema)
    got = process_available(mark_rate_limited_stream(stream, ["user"], "ts", "event_id", 1, DAY)).collect()
    assert sorted((r.event_id, r.is_limited) for r in got) == [(k, k == 6) for k in range(1, 7)]


@pytest.mark.parametrize("seed", range(6))
def test_buckets_decide_as_one_by_one(seed):
    """Rows of several keys after accepted ones of earlier micro-batches, some of them later than the rows."""
    rnd = random.Random(seed)
    limit, span = rnd.choice([(1, 50), (2, 40), (5, 100)])
    rows = []
    for group in range(30):
        held = sorted(rnd.sample(range(200), rnd.randint(0, limit)))
        start = rnd.choice([0, 150, 250])
        new = sorted(start + rnd.randrange(400) for _ in range(rnd.choice([1, 2, 20])))
        rows += [(group, t, True) for t in held] + [(group, t, False) for t in new]
    group, times, old = (np.array(c) for c in zip(*rows))
    got = decide(group, times, old, limit, span)
    alive = {}
    for (g, t, was), accepted in zip(rows, got):
        live = alive.setdefault(g, [])
        if was:
            live.append(t)
            continue
        fits = sum(t - then < span for then in live) < limit
        assert accepted == fits
        live += [t] * fits


@pytest.mark.parametrize("files", [1, 3])
def test_remembered_history_equals_one_by_one(spark, tmp_path, files):
    rnd = random.Random(files)
    rows, clock = [], 0
    for order in range(400):
        clock += rnd.choice([1, 60, 1800, 1801, 5]) if order % 40 == 0 else 5
        role = rnd.choice(["user", "user", "assistant"])
        # the second thread has no clean turn after its first
        thread = f"t{order % 2}"
        plain = rnd.random() < 0.4 if thread == "t0" else order < 2
        when = datetime(2026, 7, 19) + timedelta(seconds=clock)
        rows.append((thread, order, when, role if order > 1 else "user", plain))
    schema = "thread string, n long, ts timestamp_ntz, role string, plain boolean"
    frame = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "messages")
    step = -(-len(rows) // files)
    for part in range(files):
        piece = frame.where((F.col("n") >= part * step) & (F.col("n") < (part + 1) * step))
        piece.coalesce(1).write.mode("append").parquet(folder)
    stream = read_event_stream(spark, folder, frame.schema, maxFilesPerTrigger="1")
    clean = (F.col("role") == "user") & F.col("plain")
    result = process_available(remember_stream(stream, "thread", "ts", "n", clean, max_messages=10))
    got = {r.n: (r.history_start, r.history_length) for r in result.collect()}

    want, threads = {}, {}
    for thread, n, when, role, plain in rows:
        kept, last = threads.get(thread, ([], None))
        if last and when - last > timedelta(minutes=30):
            kept = []
        kept = kept + [(n, role == "user" and plain)]
        if len(kept) > 10:
            cuts = [i for i, (_, ok) in enumerate(kept) if ok and i >= len(kept) - 10]
            kept = kept[cuts[0]:] if cuts else kept
        threads[thread] = (kept, when)
        want[n] = (kept[0][0], len(kept))
    assert got == want
    assert max(length for _, length in got.values()) > 10


def test_a_stream_goes_on_where_it_stopped(spark, events, tmp_path):
    folder = tmp_path / "events"
    first, second = events.where("event_id < 300"), events.where("event_id >= 300")
    home = str(tmp_path / "home")
    for piece in (first, second):
        piece.coalesce(1).write.mode("append").parquet(str(folder))
        stream = read_event_stream(spark, str(folder), events.schema)
        result = process_available(
            mark_rate_limited_stream(stream, ["user_id"], "ts", "event_id", 3, DAY), home
        )
    batch = mark_rate_limited(events, ["user_id"], "ts", "event_id", 3, DAY)
    columns = ["event_id", "is_limited"]
    assert sorted(map(tuple, result.select(*columns).collect())) == sorted(
        map(tuple, batch.select(*columns).collect())
    )


def test_message_stream(spark, tmp_path):
    rows = [
        ("E1", "C1", "im", None, "U1", "1.0", None, "hello"),
        ("E2", "C1", "im", "bot_message", None, "2.0", "1.0", "answer"),
        ("E3", "C2", "channel", None, "U1", "3.0", "0.5", " <@U9>  how many? "),
        ("E4", "C1", "im", None, "U1", "4.0", "1.0", ""),
        ("E5", "C1", "im", None, "U1", "5.0", "1.0", None),
    ]
    folder = str(tmp_path / "messages")
    spark.createDataFrame(rows, MESSAGE_SCHEMA).write.json(folder)
    drain(direct_questions(read_message_stream(spark, folder)), "direct", tmp_path)
    assert [tuple(r) for r in spark.table("direct").collect()] == [
        ("E1", "U1", "1.0", "C1:1.0", "hello")
    ]
    channel = read_message_stream(spark, folder).where("channel_type = 'channel'")
    drain(mentions(channel), "mentioned", tmp_path)
    assert [tuple(r) for r in spark.table("mentioned").collect()] == [
        ("E3", "U1", "3.0", "C2:0.5", "how many?")
    ]


def test_mentions_leave_other_messages(spark):
    rows = [
        ("E1", "C1", "im", None, "U1", "1.0", None, "<@U9> hello"),
        ("E2", "C2", "channel", "bot_message", None, "2.0", "1.0", "<@U9> answer"),
        ("E3", "C2", "channel", None, "U1", "3.0", "0.5", " <@U9>  how many? "),
        ("E4", "C2", "channel", None, "U1", "4.0", None, "nobody is addressed"),
        ("E5", "C2", None, None, "U1", "5.0", None, "<@U9> no type"),
        ("E6", "C2", "channel", None, "U1", "6.0", None, None),
    ]
    found = mentions(spark.createDataFrame(rows, MESSAGE_SCHEMA)).select("event_id", "question")
    assert sorted(map(tuple, found.collect())) == [("E3", "how many?"), ("E5", "no type")]
