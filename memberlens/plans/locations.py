"""Revenue trend and booking forecast by city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.rules import decoded_text, money, number, whole
from memberlens.operators.rollup import totals_by_city
from memberlens.params import bounded_int, optional_text
from memberlens.sources.warehouse import Warehouse

MAX_MONTHS = 36


def revenue_trend(wh: Warehouse, city: str | None = None, months: int = 12) -> DataFrame:
    """Booking revenue by city and month, up to the latest booking month of the whole table."""
    optional_text("city", city)
    bounded_int("months", months, 1, MAX_MONTHS)
    totals = totals_by_city(
        wh.recent("bookings", months, ["location_id", "booking_month", "revenue"]),
        wh.sites(city), city, ["booking_month"], total_revenue=F.sum(money("revenue")),
    )
    return totals.select(
        "city", F.col("booking_month").alias("month"), number("total_revenue").alias("total_revenue")
    ).orderBy("city", "month")


def booking_forecast(wh: Warehouse, city: str | None = None) -> DataFrame:
    """Forecast bookings against the monthly capacity of every location in the city.

    The forecast names cities, not locations: a city with two locations yields two rows per month.
    """
    return forecast_by_location(wh, city).drop("location_id").orderBy("city", "forecast_month")


def forecast_by_location(wh: Warehouse, city: str | None = None) -> DataFrame:
    """The rows of :func:`booking_forecast` with their ``location_id``, unordered."""
    optional_text("city", city)
    forecast = wh.table("forecast_bookings").withColumn("city", decoded_text("city"))
    if city:
        forecast = forecast.where(F.col("city") == city)
    capacity = wh.sites(city, "monthly_capacity")
    return (
        forecast.join(capacity, "city")
        .select(
            "location_id", "city", "forecast_month",
            number("predicted_bookings").alias("predicted_bookings"),
            number("lower_bound").alias("lower_bound"),
            number("upper_bound").alias("upper_bound"),
            whole("monthly_capacity").alias("monthly_capacity"),
        )
    )
