"""Reports over small tables: base rows that aggregate to the cases worth keeping."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from memberlens.params import InvalidParameter
from memberlens.plans import compose, finance, health, locations, marketing, workforce
from memberlens.schemas import TABLES, enumerated_values
from memberlens.sources.warehouse import FrameWarehouse, ParquetWarehouse

M = {n: date(2024, n, 1) for n in range(1, 13)}


@pytest.fixture
def tables(spark):
    """A warehouse from rows given as dicts; missing columns are NULL, missing tables empty."""

    def build(**given):
        frames = {}
        for name, schema in TABLES.items():
            plain = [f for f in schema.fields if f.dataType.typeName() != "variant"]
            rows = [
                tuple(_fit(row.get(f.name), f) for f in plain) for row in given.get(name, [])
            ]
            ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain)
            frame = spark.createDataFrame(rows, ddl)
            if len(plain) < len(schema.fields):
                texts = [row.get("city") for row in given.get(name, [])] or [None]
                assert len(texts) == 1
                frame = frame.withColumn("city", F.parse_json(F.lit(texts[0])))
            frames[name] = frame
        return FrameWarehouse(spark, frames)

    return build


def _fit(value, field):
    from decimal import Decimal

    if value is not None and field.dataType.typeName() == "decimal":
        return Decimal(str(value))
    return value


def site(i, city, rooms=2, capacity=100):
    return {"location_id": i, "city": city, "treatment_rooms": rooms, "monthly_capacity": capacity}


def booking(i, month, revenue=0, count=1, service="Massage", refunds=0, refunded=0, hours=0):
    return {
        "location_id": i, "booking_month": M[month], "service_type": service,
        "booking_count": count, "revenue": revenue, "refund_count": refunds,
        "refund_amount": refunded, "therapist_hours_required": hours,
    }


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def dicts(frame):
    return [r.asDict() for r in frame.collect()]


def test_revenue_trend_is_anchored_on_the_whole_table(tables):
    wh = tables(
        location_master=[site(1, "A"), site(2, "B")],
        bookings=[booking(1, 1, 5), booking(1, 3, 10), booking(1, 3, 7), booking(2, 6, 1),
                  booking(9, 6, 99)],
    )
    assert rows(locations.revenue_trend(wh, months=4)) == [("A", M[3], 17.0), ("B", M[6], 1.0)]
    # the city filter does not move the anchor: January stays outside of the six months to June
    assert rows(locations.revenue_trend(wh, "A", 5)) == [("A", M[3], 17.0)]
    assert rows(locations.revenue_trend(wh, "A")) == [("A", M[1], 5.0), ("A", M[3], 17.0)]
    assert rows(locations.revenue_trend(wh, "Nowhere")) == []


def test_pnl_arithmetic_and_gaps(tables):
    wh = tables(
        location_master=[site(1, "A"), site(2, "B"), site(3, "B")],
        bookings=[booking(1, 6, 60000), booking(1, 6, 40000), booking(2, 6, 0), booking(3, 6, 10),
                  booking(1, 5, 10)],
        labor_costs=[
            {"location_id": 1, "month": M[6], "role": r, "headcount": 1, "total_labor_cost": 20000}
            for r in ("x", "y")
        ] + [{"location_id": 2, "month": M[6], "role": "x", "total_labor_cost": 5000},
             {"location_id": 1, "month": M[4], "role": "x", "total_labor_cost": 1}],
        operational_costs=[{"location_id": 1, "month": M[6], "cost_category": "Rent", "amount": 20000},
                           {"location_id": 2, "month": M[6], "cost_category": "Rent", "amount": 1000}],
    )
    got = rows(finance.location_pnl(wh))
    assert got[0] == ("A", M[5], 10.0, 0.0, 0.0, 0.0, 10.0, 100.0)  # no costs at all
    assert got[1] == ("A", M[6], 100000.0, 40000.0, 20000.0, 60000.0, 40000.0, 40.0)
    # no revenue: margin 0; the two locations of B are two rows; April has costs only and no row
    assert sorted(got[2:]) == [
        ("B", M[6], 0.0, 5000.0, 1000.0, 6000.0, -6000.0, 0.0),
        ("B", M[6], 10.0, 0.0, 0.0, 0.0, 10.0, 100.0),
    ]
    assert {r[0] for r in rows(finance.location_pnl(wh, "B"))} == {"B"}


def test_refunds_group_by_service_only_within_a_city(tables):
    wh = tables(
        location_master=[site(1, "A"), site(2, "B")],
        bookings=[booking(1, 6, 100, 600, "Massage", 15, 30), booking(1, 6, 50, 400, "Float", 5, 9),
                  booking(2, 6, 7, 0, "Float")],
    )
    assert rows(finance.refund_breakdown(wh)) == [
        ("A", None, 1000, 20, 39.0, 150.0, 2.0), ("B", None, 0, 0, 0.0, 7.0, 0.0),
    ]
    assert rows(finance.refund_breakdown(wh, "A")) == [
        ("A", "Float", 400, 5, 9.0, 50.0, 1.25), ("A", "Massage", 600, 15, 30.0, 100.0, 2.5),
    ]


def test_revenue_per_room_divides_by_requested_months(tables):
    wh = tables(
        location_master=[site(1, "A", 5), site(2, "B", 0)],
        bookings=[booking(1, 6, 350000), booking(1, 5, 250000), booking(2, 6, 600)],
    )
    assert rows(finance.revenue_per_room(wh)) == [
        ("A", 100000.0, 5, 20000.0), ("B", 100.0, 0, 0.0),
    ]
    assert rows(compose.room_payback(wh, 200000))[0][-1] == 10.0
    assert rows(compose.room_payback(wh, 200000))[1][-1] is None


def test_labor_cost_uses_its_own_anchor_and_mean_headcount(tables):
    def cost(month, heads, total, role="Therapist", i=1):
        return {"location_id": i, "month": M[month], "role": role, "headcount": heads,
                "total_labor_cost": total, "overtime_cost": total / 10}

    wh = tables(
        location_master=[site(1, "A")],
        bookings=[booking(1, 12, 1)],
        labor_costs=[cost(6, 8, 200000), cost(5, 12, 300000), cost(6, 0, 70, "Guard"), cost(1, 1, 9)],
    )
    assert rows(finance.labor_cost_by_role(wh, months=5)) == [
        ("A", "Guard", 0.0, 70.0, 7.0, 0.0), ("A", "Therapist", 10.0, 500000.0, 50000.0, 50000.0),
    ]
    assert rows(compose.overtime_saving(wh, 10, months=5)) == [("A", 50007.0, 5000.7)]


def test_service_and_cost_reports_sort_by_amount(tables):
    wh = tables(
        location_master=[site(1, "A")],
        bookings=[booking(1, 6, 5, 2, "Float"), booking(1, 6, 50, 3), booking(1, 5, 1, 4, "Float")],
        operational_costs=[{"location_id": 1, "month": M[2], "cost_category": c, "amount": a}
                           for c, a in (("Rent", 5), ("Supplies", 9))],
    )
    assert rows(finance.revenue_by_service(wh)) == [("A", "Massage", 3, 50.0), ("A", "Float", 6, 6.0)]
    assert rows(finance.operational_costs_by_category(wh)) == [
        ("A", "Supplies", 9.0), ("A", "Rent", 5.0),
    ]


def test_forecasts_decode_the_city_and_fan_out(tables):
    wh = tables(
        location_master=[site(1, "A", capacity=100), site(2, "A", capacity=50), site(3, "B")],
        forecast_bookings=[{"city": '"A"', "forecast_month": M[7], "predicted_bookings": 80.5,
                            "lower_bound": 70, "upper_bound": 120}],
        forecast_attrition=[{"city": '"A"', "forecast_month": M[7], "predicted_terminations": 2,
                             "worst_case_terminations": 5}],
    )
    assert sorted(rows(locations.booking_forecast(wh))) == [
        ("A", M[7], 80.5, 70.0, 120.0, 50), ("A", M[7], 80.5, 70.0, 120.0, 100),
    ]
    assert rows(locations.booking_forecast(wh, "B")) == []
    assert rows(workforce.retention_risk(wh, "A")) == [("A", M[7], 2.0, 5.0)]
    assert rows(compose.capacity_pressure(wh)) == [
        ("A", 50, 161.0, 240.0, M[7]), ("A", 100, 80.5, 120.0, None),
    ]


def test_staffing_keeps_empty_locations(tables):
    def worker(i, role, status="Active"):
        return {"location_id": i, "role": role, "employment_status": status, "hire_date": M[1]}

    def requisition(i, status, heads):
        return {"location_id": i, "role": "x", "status": status, "headcount_requested": heads}

    wh = tables(
        location_master=[site(1, "A"), site(2, "Miami")],
        bookings=[booking(2, 6, 1, 4, hours=30), booking(1, 6, 1, 4, hours=60)],
        employees=[worker(1, "Lead THERAPIST"), worker(1, "Manager"), worker(1, "Therapist", "Terminated")],
        requisitions=[requisition(1, "Open", 3), requisition(1, "Filled", 7), requisition(1, "Open", 1)],
        recruiting_costs=[{"location_id": 1, "month": M[m], "amount": 10} for m in (1, 7, 12)],
    )
    assert rows(workforce.staffing_summary(wh)) == [
        ("A", 2, 1, 2, 4, 20.0), ("Miami", 0, 0, 0, 0, 0.0),
    ]
    assert [(r["city"], r["hours_per_therapist"], r["demand_without_staff"])
            for r in dicts(compose.understaffing(wh))] == [("Miami", None, True), ("A", 10.0, False)]
    assert dicts(compose.hiring_plan(wh)) == [
        {"city": "Miami", "monthly_therapist_hours": 5.0, "open_requisitions": 0,
         "comparable_headcount": 2.0, "comparable_hours_per_therapist": 10.0,
         "suggested_therapists": 1},
    ]


def test_tenure_and_turnover(tables):
    def worker(role, status, hired, left=None, pay=100):
        return {"location_id": 1, "role": role, "employment_status": status, "hire_date": hired,
                "termination_date": left, "compensation_annual": pay}

    wh = tables(
        location_master=[site(1, "A")],
        employees=[worker("T", "Active", date(2024, 1, 31))] * 4
        + [worker("T", "Terminated", M[1], M[11], 200), worker("T", "Leave", M[1], None)]
        + [worker("L", "Leave", M[1])],
    )
    got = rows(workforce.tenure_and_turnover(wh, as_of=date(2024, 2, 1)))
    # four actives at 1 month, one leaver at 10; leave without an end date is not averaged
    assert got == [("A", "L", 0, 0.0, 0, 0.0, 100.0), ("A", "T", 4, 2.8, 1, 16.7, 116.67)]
    assert len(rows(workforce.tenure_and_turnover(wh, "A", "T"))) == 1


def test_recruiting_pipeline_keeps_null_means(tables):
    def requisition(role, status, posted, filled=None):
        return {"location_id": 1, "role": role, "status": status, "headcount_requested": 1,
                "posted_date": posted, "filled_date": filled}

    wh = tables(
        location_master=[site(1, "A")],
        requisitions=[requisition("T", "Filled", M[1], date(2024, 2, 2)),
                      requisition("T", "Filled", M[1], date(2024, 2, 3)),
                      requisition("T", "Open", date(2024, 5, 18)),
                      requisition("X", "Cancelled", M[1])],
    )
    assert rows(workforce.recruiting_pipeline(wh, as_of=date(2024, 6, 1))) == [
        ("A", "T", 1, 2, 32.5, 14.0), ("A", "X", 0, 0, None, None),
    ]


def test_campaign_reports(tables):
    def campaign(i, name, channel, budget, converted):
        return {"campaign_id": i, "campaign_name": name, "channel": channel, "budget": budget,
                "total_converted": converted, "revenue_attributed": 10}

    responses = [(1, c) for c in range(1, 5)] * 3 + [(2, 1), (3, 99)]
    wh = tables(
        campaigns=[campaign(1, "Spring", "Email", 30000, 200), campaign(2, "Spring", "Email", 20000, 300),
                   campaign(3, "Quiet", "SMS", 5, 0)],
        campaign_responses=[{"campaign_id": a, "customer_id": b} for a, b in responses],
        renewals=[{"renewal_id": 1, "customer_id": 1, "renewal_likelihood": "At Risk"},
                  {"renewal_id": 2, "customer_id": 2, "renewal_likelihood": "Very Likely"}],
        customer_tiers=[{"customer_id": 1, "churn_probability_pct": 80},
                        {"customer_id": 2, "churn_probability_pct": 15}],
    )
    assert rows(marketing.campaign_performance(wh)) == [
        ("Email", 50000.0, 500, 20.0, 100.0), ("SMS", 5.0, 0, 10.0, None),
    ]
    assert rows(marketing.campaign_performance(wh, "SMS")) == [("SMS", 5.0, 0, 10.0, None)]
    # same-named campaigns merge and count customer 1 twice; no renewal is not at risk
    assert rows(marketing.campaign_retention(wh)) == [
        ("Spring", 5, 2, 40.0, 58.3), ("Quiet", 1, 0, 0.0, 0.0),
    ]


def test_churn_reports(tables):
    def member(i, tier, risk, churn, home=1):
        return {"customer_id": i, "membership_type": tier, "churn_risk": risk, "home_location_id": home,
                "churn_probability_pct": churn, "predicted_ltv_12m": 10.005, "nps_score": 5,
                "visit_frequency_monthly": 1.5, "days_since_last_visit": churn}

    wh = tables(
        location_master=[site(1, "A"), site(2, "B")],
        customer_tiers=[member(1, "Gold", "High", 90), member(2, "Gold", "Low", 10),
                        member(3, "Basic", "Low", 11), member(4, "Basic", "Low", None, home=8)],
    )
    assert rows(health.churn_cohorts(wh, "tier")) == [
        ("Basic", 2, 10.01, 11.0, 1.5, 11.0, 5.0), ("Gold", 2, 10.01, 50.0, 1.5, 50.0, 5.0),
    ]
    assert [r[0] for r in rows(health.churn_cohorts(wh, "churnRisk"))] == ["High", "Low"]
    assert rows(health.churn_by_location(wh)) == [("A", 3, 37.0, 1, 33.3)]
    assert dicts(compose.churn_against_visits(wh))[0]["churn_visit_correlation"] == 1.0


def test_closed_values_are_checked(tables):
    wh = tables(
        customer_tiers=[{"customer_id": i, "churn_risk": risk, "ai_tier": "Gold"}
                        for i, risk in enumerate(["High", "high", None, "High"])],
    )
    got = {(r[1], r[2]): r[3:] for r in rows(enumerated_values(wh))}
    assert got == {
        ("churn_risk", "High"): (2, True), ("churn_risk", "high"): (1, False),
        ("churn_risk", None): (1, False), ("ai_tier", "Gold"): (4, True),
    }


def test_outliers_and_gaps(tables):
    wh = tables(
        location_master=[site(i, c) for i, c in enumerate("ABC")],
        bookings=[booking(0, 5, 100), booking(0, 6, 800), booking(1, 6, 100), booking(2, 6, 80)],
        operational_costs=[{"location_id": 0, "month": M[6], "cost_category": "Rent", "amount": 70},
                           {"location_id": 1, "month": M[6], "cost_category": "Rent", "amount": 20}],
        labor_costs=[{"location_id": 0, "month": M[6], "role": "T", "total_labor_cost": 900}],
    )
    got = {(r["city"], r["month"]): r for r in dicts(compose.revenue_outliers(wh))}
    assert got["A", M[6]]["change_pct"] == 700.0
    assert got["A", M[6]]["ratio_to_median"] == 8.0 and got["A", M[6]]["is_outlier"]
    assert not got["B", M[6]]["is_outlier"]
    assert rows(compose.cost_gap(wh, "A", "B")) == [
        ("labor", "T", 900.0, 0.0, 900.0), ("operations", "Rent", 70.0, 20.0, 50.0),
    ]
    losses = dicts(compose.loss_months(wh))
    assert [(r["city"], r["month"]) for r in losses] == [("A", M[6])]


@pytest.mark.parametrize(
    "call",
    [
        lambda wh: locations.revenue_trend(wh, months=37),
        lambda wh: locations.revenue_trend(wh, ""),
        lambda wh: finance.location_pnl(wh, months=25),
        lambda wh: finance.location_pnl(wh, months=0),
        lambda wh: workforce.booking_demand(wh, months=2.5),
        lambda wh: health.churn_cohorts(wh, "aiTier"),
        lambda wh: marketing.campaign_performance(wh, ""),
        lambda wh: compose.overtime_saving(wh, -1),
    ],
)
def test_arguments_are_checked_before_anything_runs(call):
    with pytest.raises(InvalidParameter):
        call(None)


def test_materialised_tables_prune_month_folders(spark, tables, tmp_path, capsys):
    wh = tables(
        location_master=[site(1, "A")],
        bookings=[booking(1, m, m) for m in range(1, 13)],
        forecast_bookings=[{"city": '"A"', "forecast_month": M[7]}],
        forecast_attrition=[{"city": '"A"', "forecast_month": M[7]}],
    )
    wh.materialise(str(tmp_path))
    stored = ParquetWarehouse(spark, str(tmp_path))
    report = locations.revenue_trend(stored, months=3)
    assert rows(report) == rows(locations.revenue_trend(wh, months=3))
    capsys.readouterr()
    report.explain("formatted")
    assert "PartitionFilters: [isnotnull(booking_month" in capsys.readouterr().out
    assert rows(workforce.retention_risk(stored)) == rows(workforce.retention_risk(wh))
