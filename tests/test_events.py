"""Admission, sessions, histories and message text."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memberlens.functions import text
from memberlens.operators import admission
from memberlens.operators.admission import admit, mark_duplicates, mark_rate_limited
from memberlens.operators.history import truncate_history
from memberlens.operators.sessions import live_threads, sessions

START = datetime(2026, 7, 19, 12)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def events(spark):
    def build(*rows):
        """Rows of user and seconds; the event id is the position."""
        data = [(i, user, None if s is None else at(s)) for i, (user, s) in enumerate(rows)]
        return spark.createDataFrame(data, "event_id long, user string, ts timestamp_ntz")

    return build


def flags(frame, column):
    return [r[0] for r in frame.orderBy("event_id").select(column).collect()]


def test_eleventh_request_is_limited(events):
    rows = [("a", 0)] * 11 + [("b", 0), ("a", 61)]
    got = flags(mark_rate_limited(events(*rows), ["user"], "ts", "event_id"), "is_limited")
    assert got == [False] * 10 + [True, False, False]


def test_rejected_requests_do_not_count_and_the_window_is_strict(events):
    rows = [("a", 0)] * 10 + [("a", 59.999999), ("a", 60), ("a", 60)]
    got = flags(mark_rate_limited(events(*rows), ["user"], "ts", "event_id"), "is_limited")
    assert got == [False] * 10 + [True, False, False]


def test_duplicates_up_to_and_including_the_ttl(events):
    rows = [("a", 0), ("a", 200), ("a", 300), ("a", 300.000001), ("b", 1), ("a", 600)]
    got = flags(mark_duplicates(events(*rows), ["user"], "ts", "event_id"), "is_duplicate")
    assert got == [False, True, True, False, False, True]


def test_events_without_key_or_time_are_accepted(events):
    rows = [(None, 0)] * 3 + [("a", None)] * 3 + [("a", 0), ("a", 1)]
    got = flags(mark_duplicates(events(*rows), ["user"], "ts", "event_id"), "is_duplicate")
    assert got == [False] * 7 + [True]


def test_redelivery_under_the_same_id(spark):
    rows = [(7, at(0)), (7, at(10)), (7, at(299)), (7, at(301)), (8, at(5))]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    marked = mark_duplicates(frame, ["event_id"], "ts", "event_id").orderBy("event_id", "ts")
    assert [r.is_duplicate for r in marked.collect()] == [False, True, True, False, False]


def one_by_one(rows, limit, span):
    accepted, alive = {}, {}
    for user, when, i in sorted(rows):
        live = [t for t in alive.get(user, []) if when - t < span]
        accepted[i] = len(live) < limit
        alive[user] = live + [when] * accepted[i]
    return accepted


@pytest.mark.parametrize(
    "limit, seconds, spread, chunk_rows",
    [(1, 300, 100, 60), (3, 60, 20, 25), (10, 60, 3, 10**6), (2, 60, 70, 10**6)],
)
def test_admission_equals_one_by_one(spark, limit, seconds, spread, chunk_rows):
    rnd = random.Random(limit)
    rows, clock = [], 0.0
    for user in range(8):
        clock = 0.0
        for _ in range(200):
            clock += rnd.choice([0, 0, 0.25, spread * rnd.random(), spread / 5, seconds * 2 * rnd.random() ** 8])
            rows.append((user, round(clock * 10**6), len(rows)))
    # one key with most of the rows, over the limit all the time
    rows += [(99, 250_000 * n, len(rows) + n) for n in range(1500)]
    frame = spark.createDataFrame(
        [(u, START + timedelta(microseconds=t), i) for u, t, i in rows],
        "user long, ts timestamp_ntz, event_id long",
    )
    got = admit(frame, ["user"], "ts", "event_id", limit, timedelta(seconds=seconds), chunk_rows)
    assert {r.event_id: r.accepted for r in got.collect()} == one_by_one(rows, limit, seconds * 10**6)


@pytest.mark.parametrize("limit, seconds, chunk_rows", [(1, 300, 60), (3, 86400, 40), (2, 7200, 10)])
def test_one_hot_unit_is_cut_finer(spark, monkeypatch, limit, seconds, chunk_rows):
    """A key with all rows in an eighth of the window, many of them at one time."""
    rnd = random.Random(seconds)
    unit = seconds * 10**6 // 8
    rows = [(1, rnd.choice([rnd.randrange(unit), rnd.randrange(50), 77]), i) for i in range(1500)]
    rows += [(1, seconds * 10**6 + rnd.randrange(unit), 5000 + i) for i in range(600)]
    rows += [(k, rnd.randrange(3 * unit), 9000 + 20 * k + i) for k in range(2, 6) for i in range(15)]
    frame = spark.createDataFrame(
        [(u, datetime(2026, 1, 1) + timedelta(microseconds=t), i) for u, t, i in rows], "user long, ts timestamp_ntz, event_id long"
    )
    taken = []
    accept = admission._accept_in_order

    def watched(group, limit, span):
        taken.append(group)
        return accept(group, limit, span)

    monkeypatch.setattr(admission, "_accept_in_order", watched)
    sizes = []
    staged = admission.stage

    def stage(frame, partition_by=None):
        written = staged(frame, partition_by)
        if partition_by == "_chunk":
            sizes.extend(r[0] for r in written.groupBy("user", "_run", "_chunk").count().select("count").collect())
        return written

    monkeypatch.setattr(admission, "stage", stage)
    got = admit(frame, ["user"], "ts", "event_id", limit, timedelta(seconds=seconds), chunk_rows)
    assert {r.event_id: r.accepted for r in got.collect()} == one_by_one(rows, limit, seconds * 10**6)
    assert taken and len(sizes) > 20 and max(sizes) <= chunk_rows


def test_refused_chunks_are_not_read(spark, monkeypatch):
    """A key over the limit all the time takes rounds for what it accepts."""
    rows = [(1, 1000 * k, k) for k in range(4000)]
    frame = spark.createDataFrame(
        [(u, START + timedelta(microseconds=t), i) for u, t, i in rows], "user long, ts timestamp_ntz, event_id long"
    )
    rounds = []
    staged = admission.stage

    def stage(frame, partition_by=None):
        if "_carried" in frame.columns and not partition_by:
            rounds.append(frame)
        return staged(frame, partition_by)

    monkeypatch.setattr(admission, "stage", stage)
    got = admit(frame, ["user"], "ts", "event_id", 2, timedelta(seconds=2), 20)
    want = one_by_one(rows, 2, 2 * 10**6)
    assert {r.event_id: r.accepted for r in got.collect()} == want
    assert sum(want.values()) == 4 and len(rounds) <= 6  # of 400 chunks


def test_sessions_keep_a_pause_of_exactly_the_limit(events):
    minutes = [0, 29, 59, 89.0001, 300]
    rows = [("a", m * 60) for m in minutes] + [("b", 0), ("a", None)]
    got = sessions(events(*rows), ["user"], "ts").orderBy("user", "session_start").collect()
    assert [(r.user, r.event_count) for r in got] == [("a", 3), ("a", 1), ("a", 1), ("b", 1)]
    assert got[0].last_event == at(59 * 60)


def test_sessions_equal_the_built_in_window(spark):
    rnd = random.Random(1)
    rows, clock = [], 0
    for i in range(600):
        clock += rnd.choice([0, 1, 600, 1800, 1799, 1801, 5000])
        rows.append((i % 3, at(clock)))
    frame = spark.createDataFrame(rows, "user long, ts timestamp")
    mine = sessions(frame, ["user"], "ts").select("user", "session_start", "last_event", "event_count")
    built_in = (
        frame.groupBy("user", F.session_window("ts", "30 minutes"))
        .agg(F.min("ts"), F.max("ts"), F.count("*")).drop("session_window")
    )
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, built_in.collect()))


def test_idle_threads_are_dropped(events):
    rows = [("kept", -29 * 60), ("edge", -30 * 60), ("gone", -31 * 60), ("kept", -90 * 60)]
    got = live_threads(events(*rows), ["user"], "ts", START).collect()
    assert sorted(r.user for r in got) == ["edge", "kept"]


@pytest.fixture
def messages(spark):
    def build(*threads):
        rows = [(c, t, role, plain) for c, turns in threads for t, (role, plain) in enumerate(turns)]
        return spark.createDataFrame(rows, "conv string, turn long, role string, plain boolean")

    return build


def kept(frame, limit=40):
    clean = (F.col("role") == "user") & F.col("plain")
    result = {}
    for r in truncate_history(frame, "conv", "turn", clean, limit).collect():
        result.setdefault(r.conv, []).append(r.turn)
    return {c: sorted(turns) for c, turns in result.items()}


def test_history_is_cut_at_a_clean_turn(messages):
    alternating = [("user" if i % 2 == 0 else "assistant", True) for i in range(50)]
    tool_talk = [("user", True)] + [("assistant" if i % 2 == 0 else "user", False) for i in range(44)]
    odd = [("user" if i % 2 == 0 else "assistant", True) for i in range(51)]
    got = kept(messages(("plain", alternating), ("tools", tool_talk), ("odd", odd), ("short", odd[:40])))
    assert got["plain"] == list(range(10, 50))
    assert got["tools"] == list(range(45))
    assert got["odd"] == list(range(12, 51))
    assert got["short"] == list(range(40))


def column(spark, value, function):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Highlights:\n- one\n- two\n* three", "Highlights:\n• one\n• two\n• three"),
        ("First.\\n\\nSecond.", "First.\n\nSecond."),
        ("a\\n- b", "a\n• b"),
        ("  - indented\n-none\n--- rule\r* cr - ls", "  • indented\n-none\n--- rule\r• cr • ls"),
        ("2 - 1", "2 - 1"),
        ("- \n- b\r\n* c\n\n  - d", "• • b\r\n• c\n\n  • d"),
        ("a\u0085- b", "a\u0085- b"),
        (" -　wide", " • wide"),
    ],
)
def test_summary_text(spark, given, expected):
    assert column(spark, given, text.summary_section) == expected


def test_summary_is_capped_in_utf16_units(spark):
    assert column(spark, "x" * 2900, text.summary_section) == "x" * 2900
    assert column(spark, "x" * 3500, text.summary_section) == "x" * 2899 + "…"
    # an emoji takes two units; one that would be halved is left out
    assert column(spark, "😀" * 1450, text.summary_section) == "😀" * 1450
    assert column(spark, "😀" * 1451, text.summary_section) == "😀" * 1449 + "…"
    assert column(spark, "x" + "😀" * 1450, text.summary_section) == "x" + "😀" * 1449 + "…"
    # bullets are put in before the cap
    assert column(spark, "-   " + "x" * 2898, text.summary_section) == "• " + "x" * 2898


def test_action_texts(spark):
    frame = spark.createDataFrame(
        [("S", ["one\\ntwo", "three"]), ("S\\nT", None), ("S", [])], "s string, a array<string>"
    )
    got = frame.select(
        text.actions_section(F.col("a")), text.fallback_text(F.col("s"), F.col("a"))
    ).collect()
    assert got[0][0] == "*Recommended Next Actions*\n• one\ntwo\n• three"
    assert got[0][1] == "S\n\nRecommended Next Actions\n- one\ntwo\n- three"
    assert tuple(got[1]) == (None, "S\nT")
    assert tuple(got[2]) == (None, "S")


def test_mentions_are_stripped_only_at_the_start(spark):
    assert column(spark, " <@U1>  hi <@U2> \n", text.strip_mention) == "hi <@U2>"
    assert column(spark, "hi <@U1>", text.strip_mention) == "hi <@U1>"
    assert column(spark, "<@U1>", text.strip_mention) == ""


def test_equal_requests_and_deliveries_are_told_apart_by_number(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    same = spark.sql(f"SELECT 'u' AS user, {at} AS ts, 1 AS place FROM range(15)")
    limited = mark_rate_limited(same, ["user"], "ts", "place")
    assert limited.count() == 15 and limited.where("is_limited").count() == 5
    again = mark_duplicates(same.limit(3), ["user"], "ts", "place")
    assert again.count() == 3 and again.where("is_duplicate").count() == 2
