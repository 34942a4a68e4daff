"""Demand, staffing, tenure, attrition and recruiting reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.rules import (
    as_of_date, decoded_text, fixed, mean, money, months_between_boundaries, number, percent, shared_money, whole,
)
from memberlens.operators.rollup import totals_by_city, totals_by_site
from memberlens.params import bounded_int, optional_text
from memberlens.sources.warehouse import Warehouse

MAX_MONTHS = 24
RECRUITING_MONTHS = 6


def _is(column: str, value: str) -> Column:
    return F.when(F.col(column) == value, 1).otherwise(0)


def booking_demand(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Bookings and therapist hours by city and month."""
    optional_text("city", city)
    bounded_int("months", months, 1, MAX_MONTHS)
    totals = totals_by_city(
        wh.recent(
            "bookings", months,
            ["location_id", "booking_month", "booking_count", "therapist_hours_required"],
        ),
        wh.sites(city), city, ["booking_month"],
        booking_count=F.sum("booking_count"), hours=F.sum(money("therapist_hours_required")),
    )
    return totals.select(
        "city",
        F.col("booking_month").alias("month"),
        whole("booking_count").alias("booking_count"),
        number("hours").alias("therapist_hours_required"),
    ).orderBy("city", "month")


def staffing_summary(wh: Warehouse, city: str | None = None) -> DataFrame:
    """Staff, open requisitions and recent recruiting spend of every location.

    Built outward from the location table: a location nobody works at has a row of zeros.
    """
    optional_text("city", city)
    sites = wh.sites(city)
    staff = totals_by_site(
        wh.table("employees", ["location_id", "role", "employment_status"]).where(
            F.col("employment_status") == "Active"
        ),
        sites, city, [],
        active_headcount=F.count("*"),
        therapist_headcount=F.sum(F.when(F.col("role").ilike("%Therapist%"), 1).otherwise(0)),
    )
    wanted = F.when(F.col("status") == "Open", F.col("headcount_requested")).otherwise(0)
    requisitions = totals_by_site(
        wh.table("requisitions", ["location_id", "status", "headcount_requested"]),
        sites, city, [],
        open_requisitions=F.sum(_is("status", "Open")), headcount_requested=F.sum(wanted),
    )
    spend = totals_by_site(
        wh.recent("recruiting_costs", RECRUITING_MONTHS, ["location_id", "amount"]),
        sites, city, [], spend=F.sum(shared_money("amount")),
    )
    counts = ["active_headcount", "therapist_headcount", "open_requisitions", "headcount_requested"]
    return (
        sites.join(staff, "location_id", "left")
        .join(requisitions, "location_id", "left")
        .join(spend, "location_id", "left")
        .select(
            "city",
            *[whole(name).alias(name) for name in counts],
            number("spend").alias("recruiting_spend_last_6_months"),
        )
        .orderBy("city")
    )


def tenure_and_turnover(
    wh: Warehouse, city: str | None = None, role: str | None = None, as_of=None
) -> DataFrame:
    """Tenure, share of all recorded staff who left, and pay, by city and role.

    Active staff count up to ``as_of`` (today by default), everybody else up to the termination
    date; without one they are left out of the mean. The turnover rate is not annualised.
    """
    optional_text("city", city)
    optional_text("role", role)
    staff = wh.table("employees")
    if role:
        staff = staff.where(F.col("role") == role)
    end = F.when(F.col("employment_status") == "Active", as_of_date(as_of)).otherwise(
        F.col("termination_date")
    )
    tenure = months_between_boundaries(F.col("hire_date"), end)
    totals = totals_by_city(
        staff.withColumn("tenure", tenure), wh.sites(city), city, ["role"],
        headcount=F.sum(_is("employment_status", "Active")),
        tenure_sum=F.sum("tenure"), tenure_rows=F.count("tenure"),
        terminated_count=F.sum(_is("employment_status", "Terminated")),
        recorded=F.count("*"),
        pay_sum=F.sum(money("compensation_annual")), pay_rows=F.count("compensation_annual"),
    )
    return totals.select(
        "city", "role",
        whole("headcount").alias("headcount"),
        number(mean(F.col("tenure_sum"), F.col("tenure_rows"))).alias(
            "avg_tenure_months"
        ),
        whole("terminated_count").alias("terminated_count"),
        percent(whole("terminated_count"), whole("recorded")).alias(
            "turnover_rate_pct"
        ),
        number(mean(F.col("pay_sum"), F.col("pay_rows"))).alias(
            "avg_compensation_annual"
        ),
    ).transform(
        fixed(avg_tenure_months=1, turnover_rate_pct=1, avg_compensation_annual=2)
    ).orderBy("city", "role")


def retention_risk(wh: Warehouse, city: str | None = None) -> DataFrame:
    """Forecast terminations by city and month."""
    optional_text("city", city)
    forecast = wh.table("forecast_attrition").withColumn("city", decoded_text("city"))
    if city:
        forecast = forecast.where(F.col("city") == city)
    return forecast.select(
        "city", "forecast_month",
        number("predicted_terminations").alias("predicted_terminations"),
        number("worst_case_terminations").alias("worst_case_terminations"),
    ).orderBy("city", "forecast_month")


def recruiting_pipeline(
    wh: Warehouse, city: str | None = None, role: str | None = None, as_of=None
) -> DataFrame:
    """Open and filled requisitions with their mean ages; the means stay NULL without any."""
    optional_text("city", city)
    optional_text("role", role)
    requisitions = wh.table("requisitions")
    if role:
        requisitions = requisitions.where(F.col("role") == role)
    to_fill = F.when(F.col("status") == "Filled", F.datediff("filled_date", "posted_date"))
    waiting = F.when(F.col("status") == "Open", F.datediff(as_of_date(as_of), "posted_date"))
    totals = totals_by_city(
        requisitions.withColumns({"to_fill": to_fill, "waiting": waiting}),
        wh.sites(city), city, ["role"],
        open_count=F.sum(_is("status", "Open")), filled_count=F.sum(_is("status", "Filled")),
        fill_sum=F.sum("to_fill"), fill_rows=F.count("to_fill"),
        wait_sum=F.sum("waiting"), wait_rows=F.count("waiting"),
    )
    return totals.select(
        "city", "role",
        whole("open_count").alias("open_count"),
        whole("filled_count").alias("filled_count"),
        mean(F.col("fill_sum"), F.col("fill_rows")).alias("avg_days_to_fill"),
        mean(F.col("wait_sum"), F.col("wait_rows")).alias(
            "avg_days_open_for_still_open"
        ),
    ).transform(fixed(avg_days_to_fill=1, avg_days_open_for_still_open=1)).orderBy("city", "role")
