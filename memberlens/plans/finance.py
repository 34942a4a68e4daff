"""Profit, refunds, room yield, labour, service and cost reports by city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.rules import fixed, mean, money, number, percent, ratio, shared_money, whole
from memberlens.operators.rollup import totals_by_city, totals_by_site
from memberlens.params import bounded_int, optional_text
from memberlens.sources.warehouse import Warehouse

MAX_MONTHS = 24


def _checked(city: str | None, months: int) -> None:
    optional_text("city", city)
    bounded_int("months", months, 1, MAX_MONTHS)


def location_pnl(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Revenue, costs, profit and margin per location and month of the booking window.

    Revenue drives the result: a month with costs only has no row, a month without costs has zero.
    A city with several locations has a row for each.
    """
    return pnl_by_location(wh, city, months).drop("location_id").orderBy("city", "month")


def pnl_by_location(wh: Warehouse, city: str | None, months: int) -> DataFrame:
    """The rows of :func:`location_pnl` with their ``location_id``, unordered.

    Costs join on (location, month), so cost months outside the booking window can never match and
    are left unread.
    """
    _checked(city, months)
    sites = wh.sites(city)
    window = wh.lookback("bookings", months)
    revenue = totals_by_site(
        wh.rows("bookings", ["location_id", "booking_month", "revenue"], window),
        sites, city, [F.col("booking_month").alias("month")],
        revenue=F.sum(money("revenue")),
    )
    labor = totals_by_site(
        wh.rows("labor_costs", ["location_id", "month", "total_labor_cost"], window),
        sites, city, ["month"], labor_cost=F.sum(shared_money("total_labor_cost")),
    )
    operations = totals_by_site(
        wh.rows("operational_costs", ["location_id", "month", "amount"], window),
        sites, city, ["month"], operational_cost=F.sum(shared_money("amount")),
    )
    joined = (
        revenue.join(labor, ["location_id", "month"], "left")
        .join(operations, ["location_id", "month"], "left")
        .join(sites, "location_id")
        .select(
            "location_id", "city", "month", number("revenue").alias("revenue"),
            number("labor_cost").alias("labor_cost"),
            number("operational_cost").alias("operational_cost"),
        )
        .withColumn("total_cost", F.col("labor_cost") + F.col("operational_cost"))
        .withColumn("profit", F.col("revenue") - F.col("total_cost"))
    )
    margin = percent(F.col("profit"), F.col("revenue"))
    return joined.withColumn("margin_pct", margin).transform(fixed(margin_pct=2))


def refund_breakdown(wh: Warehouse, city: str | None = None, months: int = 12) -> DataFrame:
    """Refunds by city, and by service type too when one city is asked for."""
    _checked(city, months)
    keys = ["service_type"] if city else []
    facts = wh.recent(
        "bookings", months,
        ["location_id", *keys, "booking_count", "refund_count", "refund_amount", "revenue"],
    )
    totals = totals_by_city(
        facts, wh.sites(city), city, keys,
        booking_count=F.sum("booking_count"), refund_count=F.sum("refund_count"),
        refund_amount=F.sum(money("refund_amount")), revenue=F.sum(money("revenue")),
    )
    service = F.col("service_type") if city else F.lit(None).cast("string")
    return totals.select(
        "city",
        service.alias("service_type"),
        whole("booking_count").alias("booking_count"),
        whole("refund_count").alias("refund_count"),
        number("refund_amount").alias("refund_amount"),
        number("revenue").alias("revenue"),
        percent(whole("refund_count"), whole("booking_count")).alias("refund_rate_pct"),
    ).transform(fixed(refund_rate_pct=2)).orderBy("city", F.asc_nulls_last("service_type"))


def revenue_per_room(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Mean monthly revenue over the requested months, in total and per treatment room."""
    _checked(city, months)
    totals = totals_by_city(
        wh.recent("bookings", months, ["location_id", "revenue"]),
        wh.sites(city, "treatment_rooms"), city, [], ("treatment_rooms",),
        revenue=F.sum(money("revenue")),
    )
    monthly = number("revenue") / months
    return totals.select(
        "city",
        monthly.alias("avg_monthly_revenue"),
        whole("treatment_rooms").alias("treatment_rooms"),
        ratio(monthly, whole("treatment_rooms")).alias("avg_monthly_revenue_per_room"),
    ).transform(fixed(avg_monthly_revenue=2, avg_monthly_revenue_per_room=2)).orderBy("city")


def labor_cost_by_role(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Mean headcount over the table's rows, summed costs, and cost per mean head."""
    _checked(city, months)
    return labor_by_role(wh, city, months).orderBy("city", "role")


def labor_by_role(wh: Warehouse, city: str | tuple[str, ...] | None, months: int) -> DataFrame:
    """The rows of :func:`labor_cost_by_role` of all, one or several cities, unordered."""
    totals = totals_by_city(
        wh.recent(
            "labor_costs", months,
            ["location_id", "role", "headcount", "total_labor_cost", "overtime_cost"],
        ),
        wh.sites(city), city, ["role"],
        heads=F.sum("headcount"), head_rows=F.count("headcount"),
        total_labor_cost=F.sum(shared_money("total_labor_cost")),
        overtime_cost=F.sum(shared_money("overtime_cost")),
    )
    headcount = number(mean(F.col("heads"), F.col("head_rows")))
    return totals.select(
        "city", "role",
        headcount.alias("headcount"),
        number("total_labor_cost").alias("total_labor_cost"),
        number("overtime_cost").alias("overtime_cost"),
        ratio(number("total_labor_cost"), headcount).alias("cost_per_employee"),
    ).transform(fixed(headcount=1, cost_per_employee=2))


def revenue_by_service(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Bookings and revenue by city and service type, best earning first within a city."""
    _checked(city, months)
    totals = totals_by_city(
        wh.recent("bookings", months, ["location_id", "service_type", "booking_count", "revenue"]),
        wh.sites(city), city, ["service_type"],
        booking_count=F.sum("booking_count"), revenue=F.sum(money("revenue")),
    )
    return totals.select(
        "city", "service_type",
        whole("booking_count").alias("booking_count"), number("revenue").alias("revenue"),
    ).orderBy("city", F.desc("revenue"), "service_type")


def operational_costs_by_category(
    wh: Warehouse, city: str | None = None, months: int = 6
) -> DataFrame:
    """Operating cost by city and category, largest first within a city."""
    _checked(city, months)
    return costs_by_category(wh, city, months).orderBy("city", F.desc("amount"), "cost_category")


def costs_by_category(wh: Warehouse, city: str | tuple[str, ...] | None, months: int) -> DataFrame:
    """The rows of :func:`operational_costs_by_category` of all, one or several cities, unordered."""
    totals = totals_by_city(
        wh.recent("operational_costs", months, ["location_id", "cost_category", "amount"]),
        wh.sites(city), city, ["cost_category"], amount=F.sum(shared_money("amount")),
    )
    return totals.select("city", "cost_category", number("amount").alias("amount"))
