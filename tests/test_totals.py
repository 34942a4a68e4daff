"""Monthly totals shared by reports, anchors from file footers, and the pieces names are searched by."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from memberlens.operators.name_match import _asked, _cut, _given, _last_ranges, _range_of, _ranges, match_names, rarest_pieces
from memberlens.plans import catalog
from memberlens.plans.catalog import Request
from memberlens.sources.retail import RetailWarehouse
from memberlens.sources.rollup import RolledUpWarehouse, write_monthly_totals
from memberlens.sources.warehouse import FrameWarehouse, ParquetWarehouse

SIX = [
    Request("revenue_trend", {"months": 36}), Request("location_pnl", {"months": 24}),
    Request("refund_breakdown", {"city": "NATION_18"}), Request("revenue_per_room"),
    Request("revenue_by_service", {"months": 3}), Request("booking_demand"),
]


class Counting(RetailWarehouse):
    """Counts how often the frame of each table is asked for."""

    def __init__(self, spark, folder):
        super().__init__(spark, folder)
        self.asked = []

    def _derive(self, name, columns, since):
        self.asked.append(name)
        return super()._derive(name, columns, since)

    def lookback(self, name, months):
        self.asked.append(name)
        return super().lookback(name, months)


def test_reports_side_by_side_read_bookings_once(spark, small):
    shared, plain = Counting(spark, small), Counting(spark, small)

    def rows(request, frame):
        return frame.columns, [tuple(r) for r in frame.collect()]

    mine = catalog.run_many(shared, SIX, rows)
    theirs = catalog.run_many(plain, SIX, rows, share=False)
    assert [o.error for o in mine] == [None] * 6
    assert [o.result for o in mine] == [o.result for o in theirs]
    assert all(len(o.result[1]) for o in mine)
    assert shared.asked.count("bookings") == 1 and plain.asked.count("bookings") >= 12
    one = Counting(spark, small)
    catalog.run_many(one, SIX[:1], rows)
    assert one.asked.count("bookings") == 2  # nothing to share


def _bookings(spark, *rows):
    fields = "location_id long, booking_month date, service_type string, booking_count long, revenue decimal(18,2), " \
        "refund_count long, refund_amount decimal(18,2), therapist_hours_required decimal(18,2)"
    return spark.createDataFrame(rows, fields)


def test_totals_are_renewed_month_by_month(spark, tmp_path):
    from decimal import Decimal as D

    def row(month, revenue, service="a", site=1):
        return (site, date(2026, month, 1), service, 1, D(revenue), None, D(0), None)

    first = _bookings(spark, row(1, "1.10"), row(1, "2.20"), row(1, "5", "b"), row(2, "3"), row(2, "4", None), row(2, "1", "a", None))
    root = str(tmp_path / "totals")
    write_monthly_totals(FrameWarehouse(spark, {"bookings": first}), root, "bookings")
    # January's rows have gone from the source since; only later months are renewed
    later = _bookings(spark, row(2, "30"), row(3, "7"), row(3, "0.01"))
    write_monthly_totals(FrameWarehouse(spark, {"bookings": later}), root, "bookings", date(2026, 2, 1))
    kept = RolledUpWarehouse(FrameWarehouse(spark, {}), root)
    got = kept.table("bookings").collect()
    assert sorted((r.booking_month.month, r.service_type, r.booking_count, str(r.revenue), r.refund_count) for r in got) == [
        (1, "a", 2, "3.30", None), (1, "b", 1, "5.00", None), (2, "a", 1, "30.00", None), (3, "a", 2, "7.01", None),
    ]
    assert kept.recent("bookings", 1, ["booking_month", "revenue"]).count() == 1
    # a missing attribute or site is a group of its own
    staged = RolledUpWarehouse(FrameWarehouse(spark, {"bookings": first}))
    assert staged.table("bookings").where("booking_month = '2026-02-01'").count() == 3


def _scanned(frame):
    """Rows out of the scans of an executed frame."""
    frame.collect()
    nodes, rows = [frame._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Scan" in node.nodeName():
            rows.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return rows


def test_the_latest_month_comes_from_footers(spark, tmp_path):
    months = spark.range(30_000).select(
        (F.col("id") % 5).alias("location_id"), F.add_months(F.lit(date(2020, 1, 1)), (F.col("id") % 40).cast("int")).alias("month"),
        F.lit("role").alias("role"), F.lit(1).cast("long").alias("headcount"),
        F.lit(2).cast("decimal(18,2)").alias("total_labor_cost"), F.lit(0).cast("decimal(18,2)").alias("overtime_cost"),
    )
    months.repartition(3).write.parquet(str(tmp_path / "labor_costs"))
    wh = ParquetWarehouse(spark, str(tmp_path))
    anchor = wh.latest_by_footers("labor_costs")
    assert "PushedAggregation: [MAX(month)]" in anchor._jdf.queryExecution().executedPlan().toString()
    assert sum(_scanned(anchor)) == 3  # one row for each file
    assert wh.recent("labor_costs", 2, ["month"]).select(F.min("month"), F.max("month")).first() == (date(2023, 3, 1), date(2023, 4, 1))
    assert wh._latest == {"labor_costs": "2023-04-01"}
    # the session itself is as before
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    months.limit(0).write.parquet(str(tmp_path / "operational_costs"))


def test_a_table_without_statistics_or_rows_is_read(spark, tmp_path):
    empty = spark.createDataFrame([], "location_id long, month date, cost_category string, amount decimal(18,2)")
    empty.write.parquet(str(tmp_path / "operational_costs"))
    wh = ParquetWarehouse(spark, str(tmp_path))
    assert wh.recent("operational_costs", 6, ["amount"]).count() == 0
    spark.createDataFrame([(1, None, "r", 1)], "location_id long, month date, role string, headcount long").write.parquet(
        str(tmp_path / "labor_costs"))
    assert wh.recent("labor_costs", 6, ["headcount"]).count() == 0


def test_names_give_out_the_pieces_that_are_asked(spark, small):
    customers = spark.read.parquet("/root/testdata/sf0.1/customer.parquet").select(F.lower("c_name").alias("_name"))
    asked = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").select(
        F.lower(F.concat(F.lit("eR "), F.substring("s_name", 10, 8))).alias("_query")
    ).distinct()
    keys = rarest_pieces(asked, customers)
    given = customers.select(_given(F.col("_name"), *_asked(keys.select(F.col("_key").alias("piece")))).alias("p"))
    rows = given.select(F.sum(F.size("p"))).first()[0]
    every = customers.select(F.sum(sum(F.size(_cut(F.col("_name"), size)) for size in (6, 3, 1)) + 1)).first()[0]
    assert rows * 10 < every
    # each piece is one of the rarest of its pattern
    assert keys.count() == asked.count()


@pytest.mark.parametrize("limit", [2, 50])
def test_matches_equal_plain_search(spark, limit):
    import random
    import re

    r = random.Random(limit)
    people = [(k, "".join(r.choice("abAB c") for _ in range(r.randint(0, 14)))) for k in range(300)] + [(900, None), (901, "")]
    texts = ["", "a", "%", "_", "ab", "a%b", "bab", "abcabc", "a b", "cab_ab%a", "abababab", "zzz", "\\", None, "AB", "b_a"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, name_query string")
    frame = spark.createDataFrame(people, "id long, name string")
    got = match_names(queries, frame, F.col("name"), "id", limit).select("query_id", "id").collect()
    want = set()
    for q, text in enumerate(texts):
        if text is None:
            continue
        like = re.compile(".*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in text.lower()) + ".*", re.DOTALL)
        want |= {(q, k) for k in sorted(k for k, name in people if name is not None and like.fullmatch(name.lower()))[:limit]}
    assert {tuple(x) for x in got} == want


def _reference_ranges(keys, starts):
    return [0 if key is None else sum(start <= key for start in starts) for key in keys]


def test_only_matches_of_the_lowest_ranges_are_ranked(spark):
    """A pattern that every name holds: the ranges left hold the first matches and few others."""
    keys = [None, *range(-2_000, 6_000, 2)]
    frame = spark.createDataFrame([(k, "bob") for k in keys], "id long, name string")
    starts = _ranges(frame, "id")
    ranged = frame.withColumn("_range", _range_of(F.col("id"), starts)).withColumn("_query", F.lit("b"))
    assert len(starts) > 400
    assert [r["_range"] for r in ranged.select("_range").collect()] == _reference_ranges(keys, starts)
    last = _last_ranges(ranged, 20).collect()
    kept = ranged.where(F.col("_range") <= last[0]["_last"]).count()
    assert len(last) == 1 and 20 <= kept < 50
    queries = spark.createDataFrame([(1, "b"), (2, "%"), (3, "x")], "query_id long, name_query string")
    got = match_names(queries, frame, F.col("name"), "id", 20).select("query_id", "id").collect()
    assert sorted((r.query_id, r.id is not None, r.id or 0) for r in got) == sorted(
        (q, k is not None, k or 0) for q in (1, 2) for k in keys[:20]
    )
