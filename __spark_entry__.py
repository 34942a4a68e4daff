
from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.functions import text
from memberlens.functions.clock import micros_of
from memberlens.operators.admission import mark_duplicates, mark_rate_limited
from memberlens.operators.answers import render_answers
from memberlens.operators.history import truncate_history
from memberlens.operators.sessions import live_threads, sessions
from memberlens.plans import (
    adhoc, compose, customers, finance, health, intake, locations, marketing, workforce,
)
from memberlens.schemas import enumerated_values
from memberlens.session import ensure_checkpoint_dir, stage
from memberlens.sources.messages import messages_from_conversations, read_event_stream, read_message_stream
from memberlens.sources.retail import AS_OF, RetailWarehouse, read_star
from memberlens.sources.rollup import RolledUpWarehouse
from memberlens.sources.sinks import json_rows
from memberlens.sources.warehouse import ParquetWarehouse
from memberlens.streaming.admission import mark_duplicates_stream, mark_rate_limited_stream
from memberlens.streaming.history import remember_stream
from memberlens.streaming.messages import direct_questions, mentions
from memberlens.streaming.run import new_checkpoint, process_available
from memberlens.streaming.sessions import joined, open_fragments, session_fragments
from oracles import activity, reports
from oracles import compose as composed
from oracles import customers as lookups

try:  # the training-data subpackage and its pipeline may be left out
    import corpus_pipeline
    from memberlens.llm import queries as training
except ImportError:
    corpus_pipeline = training = None

CITY = "NATION_18"
OTHER_CITY = "NATION_8"
ROLE = "Therapist"
CHANNEL = "ECONOMY"

Query = Callable[[SparkSession, str], DataFrame]


def _report(function: Callable[..., DataFrame], **arguments) -> Query:
    return lambda spark, folder: function(RetailWarehouse(spark, folder), **arguments)


def _ids(wh: RetailWarehouse) -> DataFrame:
    """Part keys as customer ids; they outnumber the customers, so some are unknown."""
    return wh.source("part").select(F.col("p_partkey").alias("customer_id"))


def _lookup(function: Callable[..., DataFrame], **arguments) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        wh = RetailWarehouse(spark, folder)
        return function(wh, _ids(wh), **arguments)

    return run


def _search(spark: SparkSession, folder: str) -> DataFrame:
    """Long, one-digit and wildcard queries made from suppliers, nations and regions."""
    wh = RetailWarehouse(spark, folder)

    def numbered(table: str, prefix: str, key: str, query: F.Column) -> DataFrame:
        query_id = F.concat(F.lit(prefix), F.col(key).cast("string"))
        return wh.source(table).select(query_id.alias("query_id"), query.alias("name_query"))

    start = F.concat(F.lit("eR "), F.substring("s_name", 10, 8))
    pattern = F.concat(F.lit("c_st%00"), F.col("r_regionkey").cast("string"))
    queries = (
        numbered("supplier", "s", "s_suppkey", start)
        .unionByName(numbered("nation", "n", "n_nationkey", F.col("n_nationkey").cast("string")))
        .unionByName(numbered("region", "r", "r_regionkey", pattern))
    )
    return customers.search_customers(wh, queries)


def _customer_360(spark: SparkSession, folder: str) -> DataFrame:
    wh = RetailWarehouse(spark, folder)
    listed = F.transform(
        "recent_activity",
        lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["event_type"]),
    )
    return compose.customer_360(wh, _ids(wh)).select(
        "customer_id", "found", "last_name", "membership_type", "has_renewal", "renewal_date",
        "renewal_likelihood", "has_offer", "has_health", "ai_tier", "churn_risk",
        "churn_probability_pct", F.array_join(listed, ",").alias("activity"),
    )


def _readonly_sql(spark: SparkSession, folder: str) -> DataFrame:
    RetailWarehouse(spark, folder).register(["membership_history", "customers"])
    return adhoc.run_readonly_sql(
        spark,
        """
        WITH joined AS (
          SELECT m.event_type, c.membership_type
          FROM membership_history m JOIN customers c ON c.customer_id = m.customer_id)
        SELECT event_type, membership_type, count(*) AS events
        FROM joined GROUP BY event_type, membership_type
        """,
    )


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as plain text, the others as JSON parts; system turns have no text part."""
    turns = read_star(spark, folder, "conversations")
    statement = F.struct(F.concat(F.lit("SELECT "), F.col("turn").cast("string")).alias("statement"))
    said = F.to_json(F.struct("text"))
    reply = (
        F.when(F.col("role") == "user", F.col("text"))
        .when(F.col("role") == "system", F.concat(F.lit("["), F.to_json(statement), F.lit("]")))
        .otherwise(F.concat(F.lit("["), said, F.lit(", "), F.to_json(statement), F.lit("]")))
    )
    return adhoc.read_replies(turns.select("conv_id", "turn", reply.alias("reply")), "reply").drop(
        "reply"
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "events")


def _duplicates(**arguments) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = _events(spark, folder).select("user_id", "event_type", "ts", "event_id")
        marked = mark_duplicates(events, ["user_id", "event_type"], "ts", "event_id", **arguments)
        return marked.select("event_id", "is_duplicate")

    return run


def _rate_limit(**arguments) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = _events(spark, folder).select("user_id", "ts", "event_id")
        marked = mark_rate_limited(events, ["user_id"], "ts", "event_id", **arguments)
        return marked.select("event_id", "is_limited")

    return run


def _event_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    schema = _events(spark, folder).schema
    # a pattern, since the stream source takes a plain path for a folder only
    return read_event_stream(spark, f"{folder}/{{events.parquet}}", schema).select(*columns)


def _delivered(frame: DataFrame, part: F.Column) -> DataFrame:
    """``frame`` as a stream of deliveries, one for each micro-batch: row by row, ``part`` tells which.

    Each is written by several tasks, as a fixed number of files that one micro-batch takes.
    """
    spark = frame.sparkSession
    placed = stage(frame.withColumn("part", part.cast("long")))
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # one row for each delivery
    files = min([int(spark.conf.get("spark.sql.shuffle.partitions")), *counts.values()])
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    for number in sorted(counts):
        placed.where(F.col("part") == number).drop("part").repartition(files).write.mode("append").parquet(root)
    if not counts:
        frame.write.parquet(root)
    return read_event_stream(spark, root, frame.schema, maxFilesPerTrigger=files)


def _share(us: F.Column, low: int | None, high: int | None, deliveries: int) -> F.Column:
    """The delivery of a row by its time; rows without one come first."""
    part = F.floor(F.lit(deliveries) * (us - F.lit(low or 0)) / F.lit((high or 0) - (low or 0) + 1))
    return F.coalesce(part, F.lit(0))


def _in_turn(spark: SparkSession, folder: str, columns: list[str], deliveries: int = 4) -> DataFrame:
    """The events as deliveries in order of time."""
    events = _events(spark, folder).select(*columns)
    us = micros_of(events, "ts")
    return _delivered(events, _share(us, *events.agg(F.min(us), F.max(us)).first(), deliveries))


def _turns_in_turn(frame: DataFrame, second: F.Column, late: F.Column | None = None) -> DataFrame:
    """Four deliveries in order of the turns, ``late`` ones some deliveries later."""
    low, high = frame.agg(F.min(second), F.max(second)).first()
    part = _share(second.cast("long"), low and int(low), high and int(high), 4)
    return _delivered(frame, part if late is None else F.least(part + late, F.lit(3)))


def _intake_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every message delivered twice, the second time a micro-batch later where there is one."""
    messages = messages_from_conversations(spark, folder)
    both = messages.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1))))
    stream = _turns_in_turn(both, F.col("ts").cast("long"), F.col("late")).drop("late")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = process_available(intake.intake_stream(stream, limit=2, max_messages=3, buckets=buckets))
    return asked.select("event_id", "thread_key", "question", "is_limited", "history_length")


def _remembered_stream(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_star(spark, folder, "conversations").select("conv_id", "turn", "role")
    stream = _turns_in_turn(turns, F.col("turn")).withColumn("at", F.timestamp_seconds("turn"))
    kept = remember_stream(stream, "conv_id", "at", "turn", F.col("role") == "user", max_messages=4)
    return process_available(kept).drop("at", "role")


def _message_stream(function: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/messages-{uuid.uuid4().hex}"
        messages_from_conversations(spark, folder).write.json(root)
        return process_available(function(read_message_stream(spark, root)))

    return run


def _duplicates_in_turn(spark: SparkSession, folder: str) -> DataFrame:
    stream = _in_turn(spark, folder, ["user_id", "event_type", "ts", "event_id"])
    marked = mark_duplicates_stream(
        stream, ["user_id", "event_type"], "ts", "event_id", timedelta(days=1)
    )
    return process_available(marked).select("event_id", "is_duplicate")


def _rate_limit_in_turn(spark: SparkSession, folder: str) -> DataFrame:
    stream = _in_turn(spark, folder, ["user_id", "ts", "event_id"])
    marked = mark_rate_limited_stream(stream, ["user_id"], "ts", "event_id", 3, timedelta(days=1))
    return process_available(marked).select("event_id", "is_limited")


def _live_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Users still remembered at the time of the last event."""
    events = _events(spark, folder).select("user_id", "ts")
    now = events.agg(F.max("ts")).scalar()
    return live_threads(events, ["user_id"], "ts", now, timedelta(days=1))


def _intake(spark: SparkSession, folder: str) -> DataFrame:
    """Every message delivered twice, two requests a minute."""
    messages = messages_from_conversations(spark, folder)
    return intake.intake(messages.unionByName(messages), limit=2)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _intake(spark, folder).select("event_id", "thread_key", "question", "is_limited")


def _remembered(spark: SparkSession, folder: str) -> DataFrame:
    return intake.remembered(_intake(spark, folder), 2).select("event_id", "thread_key", "question")


def _json_rows(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_star(spark, folder, "customer")
    segment = F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")
    return json_rows(customer.select("c_custkey", "c_name", segment))


#: folders of warehouses written by this application, by the tables' folder
_WRITTEN: dict[tuple[str, str], tuple[str, set[str]]] = {}


def _written(spark: SparkSession, folder: str, *tables: str) -> str:
    """A shared warehouse written by month, with at least ``tables``; each is written once in an application."""
    root, present = _WRITTEN.setdefault(
        (spark.sparkContext.applicationId, folder),
        (f"{ensure_checkpoint_dir(spark).rstrip('/')}/warehouse-{uuid.uuid4().hex}", set()),
    )
    missing = [table for table in tables if table not in present]
    RetailWarehouse(spark, folder).materialise(root, missing)
    present.update(missing)
    return root


def _stored(function: Callable[..., DataFrame], *tables: str, **arguments) -> Query:
    """The report over tables written by month, where whole months are skipped."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        root = _written(spark, folder, *tables, "location_master")
        return function(ParquetWarehouse(spark, root), **arguments)

    return run


_TOTALS: dict[tuple[str, str], RolledUpWarehouse] = {}


def _on_totals(function: Callable[..., DataFrame], **arguments) -> Query:
    """The report over monthly totals that are summed once and shared by all such reports."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder)
        if key not in _TOTALS:
            _TOTALS[key] = RolledUpWarehouse(RetailWarehouse(spark, folder))
        return function(_TOTALS[key], **arguments)

    return run


def _duplicates_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = _in_turn(spark, folder, ["user_id", "event_type", "ts", "event_id"], 1)
    marked = mark_duplicates_stream(
        stream, ["user_id", "event_type"], "ts", "event_id", timedelta(days=1)
    )
    return process_available(marked).select("event_id", "is_duplicate")


def _rate_limit_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = _in_turn(spark, folder, ["user_id", "ts", "event_id"], 1)
    marked = mark_rate_limited_stream(stream, ["user_id"], "ts", "event_id", 3, timedelta(days=1))
    return process_available(marked).select("event_id", "is_limited")


def _sessions_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions of the stream, in whatever order its files come: those emitted and those still open."""
    stream = _event_stream(spark, folder, ["user_id", "ts"])
    home = new_checkpoint(spark)
    closed = process_available(session_fragments(stream, ["user_id"], "ts"), home)
    found = closed.unionByName(open_fragments(closed, home))
    return joined(found, ["user_id"], kind=stream.schema["ts"].dataType.typeName())


def _doubled_events(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).select("user_id", "event_type", "ts", "event_id")
    return events.unionByName(events)


def _duplicates_redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """Every event delivered twice: of equal deliveries one is new at most."""
    marked = mark_duplicates(_doubled_events(spark, folder), ["event_id"], "ts", "event_id")
    return marked.groupBy("event_id").agg(
        F.count("*").alias("deliveries"), F.sum(F.col("is_duplicate").cast("long")).alias("duplicates")
    )


def _rate_limit_redelivered(spark: SparkSession, folder: str) -> DataFrame:
    events = _doubled_events(spark, folder)
    marked = mark_rate_limited(events, ["user_id"], "ts", "event_id", limit=3, window=timedelta(days=1))
    return marked.groupBy("event_id").agg(
        F.count("*").alias("requests"), F.sum(F.col("is_limited").cast("long")).alias("limited")
    )


def _bound_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A query with named values."""
    RetailWarehouse(spark, folder).register(["customers"])
    return adhoc.run_readonly_sql(
        spark,
        "SELECT membership_type, count(*) AS customers FROM customers WHERE membership_type <> :other GROUP BY 1",
        {"other": "BUILDING"},
    )


def _sessions(**arguments) -> Query:
    return lambda spark, folder: sessions(_events(spark, folder), ["user_id"], "ts", **arguments)


def _history(max_messages: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        turns = read_star(spark, folder, "conversations")
        return truncate_history(turns, "conv_id", "turn", F.col("role") == "user", max_messages)

    return run


def _thread_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = text.thread_key(F.col("channel"), F.col("thread_ts"), F.col("ts"))
    return messages_from_conversations(spark, folder).select("event_id", key.alias("thread_key"))


def _direct_messages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = text.is_direct_message(F.col("subtype"), F.col("channel_type"), F.col("text"))
    return messages_from_conversations(spark, folder).where(wanted).select(
        "event_id", "channel", "ts", "text"
    )


def _message_text(spark: SparkSession, folder: str) -> DataFrame:
    question = text.strip_mention(F.col("text"))
    return messages_from_conversations(spark, folder).select("event_id", question.alias("question"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    r"""Documents as answers: a list mark before every line, a literal ``\n``, actions for English."""
    marked = F.concat(
        F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n* ")), F.lit("\\nend")
    )
    actions = F.when(
        F.col("lang") == "en",
        F.array(
            F.concat(F.lit("Check "), "source", F.lit("\\nthen "), "lang"),
            F.concat(F.lit("Keep "), "lang"),
        ),
    )
    answers = read_star(spark, folder, "documents").select(
        "doc_id", marked.alias("summary"), actions.alias("actions")
    )
    return render_answers(answers, "summary", "actions").drop("summary", "actions")


def entry(spark: SparkSession) -> DataFrame:
    """Profit and loss by location and month."""
    return finance.location_pnl(RetailWarehouse(spark, "/root/testdata/sf0.001"))


def _entries() -> dict[str, tuple[Query, str | None]]:
    """Query and statement per name; a statement of None means rows-only."""
    day = timedelta(days=1)
    return {
        "r01_search_customers": (_search, lookups.search_customers()),
        "r02_customer_profiles": (
            _lookup(customers.customer_profiles), lookups.lookup("customers")),
        "r03_customer_renewals": (_lookup(customers.customer_renewals), lookups.lookup("renewals")),
        "r04_upgrade_offers": (
            _lookup(customers.upgrade_offers), lookups.lookup("upgrade_offers")),
        "r05_recent_activity": (
            _lookup(customers.recent_activity), lookups.recent_activity(5)),
        "r05_recent_activity_20": (
            _lookup(customers.recent_activity, limit=20), lookups.recent_activity(20)),
        "r06_customer_health": (
            _lookup(customers.customer_health), lookups.lookup("customer_tiers")),
        "r07_churn_cohorts_tier": (
            _report(health.churn_cohorts, group_by="tier"), reports.churn_cohorts("tier")),
        "r07_churn_cohorts_risk": (
            _report(health.churn_cohorts, group_by="churnRisk"),
            reports.churn_cohorts("churnRisk")),
        "r08_churn_by_location": (_report(health.churn_by_location), reports.churn_by_location()),
        "r09_revenue_trend": (_report(locations.revenue_trend), reports.revenue_trend()),
        "r09_revenue_trend_city": (
            _report(locations.revenue_trend, city=CITY, months=36),
            reports.revenue_trend(36, CITY)),
        "r10_booking_forecast": (_report(locations.booking_forecast), reports.booking_forecast()),
        "r10_booking_forecast_city": (
            _report(locations.booking_forecast, city=CITY), reports.booking_forecast(CITY)),
        "r11_location_pnl": (_report(finance.location_pnl), reports.location_pnl()),
        "r11_location_pnl_city": (
            _report(finance.location_pnl, city=CITY, months=24), reports.location_pnl(24, CITY)),
        "r12_refund_breakdown": (_report(finance.refund_breakdown), reports.refund_breakdown()),
        "r12_refund_breakdown_city": (
            _report(finance.refund_breakdown, city=CITY), reports.refund_breakdown(12, CITY)),
        "r13_revenue_per_room": (_report(finance.revenue_per_room), reports.revenue_per_room()),
        "r13_revenue_per_room_city": (
            _report(finance.revenue_per_room, city=CITY, months=24),
            reports.revenue_per_room(24, CITY)),
        "r14_labor_cost_by_role": (
            _report(finance.labor_cost_by_role), reports.labor_cost_by_role()),
        "r14_labor_cost_by_role_city": (
            _report(finance.labor_cost_by_role, city=CITY, months=24),
            reports.labor_cost_by_role(24, CITY)),
        "r15_revenue_by_service": (
            _report(finance.revenue_by_service), reports.revenue_by_service()),
        "r15_revenue_by_service_city": (
            _report(finance.revenue_by_service, city=CITY, months=24),
            reports.revenue_by_service(24, CITY)),
        "r16_operational_costs_by_category": (
            _report(finance.operational_costs_by_category),
            reports.operational_costs_by_category()),
        "r16_operational_costs_by_category_city": (
            _report(finance.operational_costs_by_category, city=CITY, months=24),
            reports.operational_costs_by_category(24, CITY)),
        "r17_booking_demand": (_report(workforce.booking_demand), reports.booking_demand()),
        "r17_booking_demand_city": (
            _report(workforce.booking_demand, city=CITY, months=24),
            reports.booking_demand(24, CITY)),
        "r18_staffing_summary": (_report(workforce.staffing_summary), reports.staffing_summary()),
        "r18_staffing_summary_city": (
            _report(workforce.staffing_summary, city=CITY), reports.staffing_summary(CITY)),
        "r19_tenure_and_turnover": (
            _report(workforce.tenure_and_turnover, as_of=AS_OF), reports.tenure_and_turnover()),
        "r19_tenure_and_turnover_role": (
            _report(workforce.tenure_and_turnover, role=ROLE, city=CITY, as_of=AS_OF),
            reports.tenure_and_turnover(CITY, ROLE)),
        "r20_retention_risk": (_report(workforce.retention_risk), reports.retention_risk()),
        "r20_retention_risk_city": (
            _report(workforce.retention_risk, city=CITY), reports.retention_risk(CITY)),
        "r21_recruiting_pipeline": (
            _report(workforce.recruiting_pipeline, as_of=AS_OF), reports.recruiting_pipeline()),
        "r21_recruiting_pipeline_role": (
            _report(workforce.recruiting_pipeline, role=ROLE, as_of=AS_OF),
            reports.recruiting_pipeline(role=ROLE)),
        "r22_campaign_performance": (
            _report(marketing.campaign_performance), reports.campaign_performance()),
        "r22_campaign_performance_channel": (
            _report(marketing.campaign_performance, channel=CHANNEL),
            reports.campaign_performance(CHANNEL)),
        "r23_campaign_retention": (
            _report(marketing.campaign_retention), reports.campaign_retention()),
        "dq_enumerated_values": (_report(enumerated_values), reports.enumerated_values()),
        "q01_readonly_sql": (_readonly_sql, activity.readonly_sql()),
        "q01_bound_values": (_bound_sql, activity.bound_sql()),
        "e01_redelivered": (_duplicates_redelivered, activity.redelivered_duplicates()),
        "e02_redelivered": (_rate_limit_redelivered, activity.redelivered_limits(3, "1 DAY")),
        "q01_read_replies": (_replies, activity.replies()),
        "e01_duplicates": (
            _duplicates(), activity.admission(
                "user_id, event_type", 1, "5 MINUTE", False, "is_duplicate")),
        "e01_duplicates_day": (
            _duplicates(ttl=day), activity.admission(
                "user_id, event_type", 1, "1 DAY", False, "is_duplicate")),
        "e02_rate_limit": (
            _rate_limit(), activity.admission("user_id", 10, "60 SECOND", True, "is_limited")),
        "e02_rate_limit_day": (
            _rate_limit(limit=3, window=day), activity.admission(
                "user_id", 3, "1 DAY", True, "is_limited")),
        "e03_sessions": (_sessions(), activity.sessions("user_id", "30 MINUTE")),
        "e03_sessions_day": (_sessions(idle=day), activity.sessions("user_id", "1 DAY")),
        "e01_duplicates_stream": (
            _duplicates_stream, activity.admission(
                "user_id, event_type", 1, "1 DAY", False, "is_duplicate")),
        "e02_rate_limit_stream": (
            _rate_limit_stream, activity.admission("user_id", 3, "1 DAY", True, "is_limited")),
        "e01_duplicates_in_turn": (
            _duplicates_in_turn, activity.admission(
                "user_id, event_type", 1, "1 DAY", False, "is_duplicate")),
        "e02_rate_limit_in_turn": (
            _rate_limit_in_turn, activity.admission("user_id", 3, "1 DAY", True, "is_limited")),
        "e03_live_threads": (_live_threads, activity.live_threads("1 DAY")),
        "e09_intake": (_questions, activity.intake(2)),
        "e09_remembered": (_remembered, activity.remembered(2, 2)),
        "s01_json_rows": (_json_rows, activity.json_rows()),
        "r09_revenue_trend_stored": (
            _stored(locations.revenue_trend, "bookings"), reports.revenue_trend()),
        "r11_location_pnl_stored": (
            _stored(finance.location_pnl, "bookings", "labor_costs", "operational_costs"),
            reports.location_pnl()),
        "r14_labor_cost_by_role_stored": (
            _stored(finance.labor_cost_by_role, "labor_costs"), reports.labor_cost_by_role()),
        "r09_revenue_trend_totals": (_on_totals(locations.revenue_trend), reports.revenue_trend()),
        "r11_location_pnl_totals": (_on_totals(finance.location_pnl), reports.location_pnl()),
        "r12_refund_breakdown_totals": (
            _on_totals(finance.refund_breakdown, city=CITY), reports.refund_breakdown(12, CITY)),
        "r13_revenue_per_room_totals": (
            _on_totals(finance.revenue_per_room), reports.revenue_per_room()),
        "r15_revenue_by_service_totals": (
            _on_totals(finance.revenue_by_service), reports.revenue_by_service()),
        "r16_operational_costs_totals": (
            _on_totals(finance.operational_costs_by_category), reports.operational_costs_by_category()),
        "r17_booking_demand_totals": (_on_totals(workforce.booking_demand), reports.booking_demand()),
        "e03_sessions_stream": (
            _sessions_stream, activity.sessions("user_id", "30 MINUTE")),
        "e04_remembered_stream": (_remembered_stream, activity.remembered_turns(4)),
        "e06_direct_stream": (_message_stream(direct_questions), activity.direct_questions()),
        "e07_mentions_stream": (_message_stream(mentions), activity.mentions()),
        "e09_intake_stream": (_intake_stream, activity.intake_remembered(2, 3)),
        "e04_truncated_history": (_history(4), activity.truncated_history(4)),
        "e04_truncated_history_default": (_history(40), activity.truncated_history(40)),
        "e05_thread_keys": (_thread_keys, activity.thread_keys()),
        "e06_direct_messages": (_direct_messages, activity.direct_messages()),
        "e07_message_text": (_message_text, activity.message_text()),
        "e08_answers": (_answers, activity.answers()),
        "c01_customer_360": (_customer_360, lookups.customer_360()),
        "c02_revenue_outliers": (_report(compose.revenue_outliers), composed.revenue_outliers()),
        "c03_margin_trend": (_report(compose.margin_trend), composed.margin_trend()),
        "c03_loss_months": (
            _report(compose.loss_months, months=24), composed.margin_trend(24, losses_only=True)),
        "c04_understaffing": (_report(compose.understaffing), composed.understaffing()),
        "c05_room_payback": (
            _report(compose.room_payback, room_cost=200000), composed.room_payback(200000)),
        "c06_capacity_pressure": (_report(compose.capacity_pressure), composed.capacity_pressure()),
        "c07_churn_against_visits": (
            _report(compose.churn_against_visits), composed.churn_against_visits()),
        "c08_overtime_saving": (
            _report(compose.overtime_saving, cut_pct=15), composed.overtime_saving(15)),
        "c09_staffing_against_churn": (
            _report(compose.staffing_against_churn), composed.staffing_against_churn()),
        "c10_cost_gap": (
            _report(compose.cost_gap, city=CITY, other_city=OTHER_CITY),
            composed.cost_gap(CITY, OTHER_CITY)),
        "c11_quarterly_demand": (_report(compose.quarterly_demand), composed.quarterly_demand()),
        "c12_hiring_plan": (_report(compose.hiring_plan), composed.hiring_plan()),
    }


def queries() -> dict[str, Query]:
    named = {name: query for name, (query, _) in _entries().items()}
    if training is not None:
        named |= training.queries() | {"pipeline": corpus_pipeline.run}
    return named


def oracle_sql() -> dict[str, str]:
    statements = {name: text for name, (_, text) in _entries().items() if text is not None}
    if training is not None:
        statements |= training.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements
