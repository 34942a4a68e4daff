"""The intake job on messages with known results, and look-backs that read only their months."""

from memberlens.plans import intake, locations
from memberlens.session import ON_HEAP, STATE_STORE
from memberlens.sources.messages import MESSAGE_SCHEMA, read_event_stream
from memberlens.sources.retail import RetailWarehouse
from memberlens.sources.warehouse import ParquetWarehouse
from memberlens.streaming.run import process_available


def test_intake(spark):
    def direct(event, second, user="U1", text="hi"):
        return (event, "D1", "im", None, user, str(second), "0", text)

    messages = spark.createDataFrame(
        [
            direct("a", 1), direct("a", 1), direct("a", 2),  # deliveries of one event count once
            direct("b", 3), direct("c", 4), direct("d", 61.5), direct("e", 5, user=None),
            ("f", "C1", "channel", None, "U2", "9.000001", None, " <@U0>  what now "),
            ("g", "C1", "channel", None, "U2", "10", None, "not addressed"),
            ("h", "D1", "im", "bot_message", None, "11", None, "by a bot"), direct("i", 12, text=""),
        ],
        MESSAGE_SCHEMA,
    )
    questions = intake.intake(messages, limit=2)
    got = {r.event_id: (r.thread_key, r.question, r.is_limited) for r in questions.collect()}
    assert questions.count() == len(got)
    assert got == {
        "a": ("D1:0", "hi", False), "b": ("D1:0", "hi", False), "c": ("D1:0", "hi", True), "d": ("D1:0", "hi", False),
        "e": ("D1:0", "hi", False), "f": ("C1:9.000001", "what now", False),
    }
    kept = intake.remembered(questions, max_messages=2).collect()
    assert sorted(r.event_id for r in kept) == ["d", "e", "f"]


def test_intake_on_a_stream(spark, tmp_path):
    """One query over several micro-batches: redeliveries, a limited user, idle threads."""
    def direct(event, second, user="U1", thread="0", text="hi"):
        return (event, "D1", "im", None, user, str(second), thread, text)

    batches = [
        [direct("a", 1), direct("a", 1), direct("b", 3)],
        [direct("a", 2), direct("c", 4), direct("e", 5, user=None), ("g", "C1", "channel", None, "U2", "10", None, "not addressed")],
        [direct("b", 3), direct("d", 61.5), direct("d", 62), direct("x", 70, user="U3", thread="9")],
        [direct("f", 3000), direct("a", 3001), direct("y", 3002, user="U3", thread="9")],
    ]
    folder = str(tmp_path / "messages")
    for rows in batches:
        spark.createDataFrame(rows, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = read_event_stream(spark, folder, MESSAGE_SCHEMA, maxFilesPerTrigger="1")
    asked = process_available(intake.intake_stream(stream, limit=2, max_messages=2, buckets=3)).collect()
    got = sorted((r.event_id, r["at"].timestamp(), r.is_limited, r.history_length) for r in asked)
    assert got == [
        ("a", 1.0, False, 1), ("a", 3001.0, False, 2),  # the second one after its time to live
        ("b", 3.0, False, 2), ("c", 4.0, True, None), ("d", 61.5, False, 2), ("e", 5.0, False, 2),
        ("f", 3000.0, False, 1), ("x", 70.0, False, 1), ("y", 3002.0, False, 1),
    ]


def test_intake_on_a_stream_of_a_session_with_the_default_state_store(spark, tmp_path):
    rows = [("a", "D1", "im", None, "U1", second, "0", "hi") for second in ("1", "2")]
    folder = str(tmp_path / "messages")
    spark.createDataFrame(rows, MESSAGE_SCHEMA).coalesce(1).write.parquet(folder)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_HEAP)
    try:
        stream = read_event_stream(spark, folder, MESSAGE_SCHEMA)
        asked = process_available(intake.intake_stream(stream, buckets=3)).collect()
    finally:
        spark.conf.set(STATE_STORE, before)
    assert [(r.event_id, r["at"].timestamp(), r.history_length) for r in asked] == [("a", 1.0, 1)]


def test_look_back_over_month_folders_reads_those_months_only(spark, small, tmp_path):
    derived = RetailWarehouse(spark, small)
    derived.materialise(str(tmp_path), ["bookings", "location_master"])
    written = ParquetWarehouse(spark, str(tmp_path))
    window = written.recent("bookings", 3, ["location_id", "booking_month"])
    wanted = window.count()
    assert 0 < wanted < written.table("bookings").count()
    window.collect()
    plan = window._jdf.queryExecution().executedPlan()
    nodes, scans = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if node.nodeName() == "ResultQueryStage":
            nodes.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            scans.append(metrics.get("numOutputRows").get().value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    assert scans and max(scans) <= wanted
    mine, theirs = (locations.revenue_trend(wh, months=3) for wh in (written, derived))
    assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))
