"""Analyses built from the reports: what an analyst would work out from several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.rules import fixed, money, number, ratio, whole
from memberlens.params import InvalidParameter, bounded_int, required_text
from memberlens.plans import customers, finance, health, locations, workforce
from memberlens.sources.warehouse import Warehouse

OUTLIER_RATIO = 5.0
_EXACT = "decimal(12,4)"
_STAFF_COUNTS = [
    "active_headcount", "therapist_headcount", "open_requisitions", "headcount_requested",
]


def _non_negative(name: str, value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
        raise InvalidParameter(f"{name} must be a number of zero or more")
    return float(value)


def _staff_by_city(wh: Warehouse, city: str | None = None) -> DataFrame:
    """Staffing summed over the locations of a city."""
    sums = [F.sum(name).alias(name) for name in _STAFF_COUNTS]
    return workforce.staffing_summary(wh, city).groupBy("city").agg(*sums)


def _demand_by_city(wh: Warehouse, city: str | None, months: int) -> DataFrame:
    """Bookings and therapist hours over the window."""
    return (
        workforce.booking_demand(wh, city, months)
        .groupBy("city")
        .agg(
            F.sum("booking_count").alias("booking_count"),
            F.sum(money("therapist_hours_required")).alias("hours"),
        )
    )


def customer_360(
    wh: Warehouse, ids: DataFrame, events: int = customers.DEFAULT_ACTIVITY
) -> DataFrame:
    """Profile, renewal, offer, health and the latest events of every id, one row each."""
    one = ids.select("customer_id").distinct()
    activity = customers.recent_activity(wh, one, events)
    fields = ["event_date", "event_id", "event_type", "from_tier", "to_tier", "campaign_id"]
    # at most ``events`` structs per customer are left by now
    latest = activity.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("recent_activity")
    )
    renewal = customers.customer_renewals(wh, one).select(
        "customer_id", "renewal_date", "renewal_probability_pct", "renewal_likelihood",
        "upgrade_candidate", F.col("found").alias("has_renewal"),
    )
    offer = customers.upgrade_offers(wh, one).select(
        "customer_id", "recommended_tier", "ai_upgrade_pitch", F.col("found").alias("has_offer")
    )
    risk = customers.customer_health(wh, one).select(
        "customer_id", "ai_tier", "churn_risk", "churn_probability_pct", "predicted_ltv_12m",
        "ai_recommendation", F.col("found").alias("has_health"),
    )
    profile = customers.customer_profiles(wh, one)
    return (
        profile.join(renewal, "customer_id", "left")
        .join(offer, "customer_id", "left")
        .join(risk, "customer_id", "left")
        .join(latest, "customer_id", "left")
    )


def revenue_outliers(wh: Warehouse, months: int = 12) -> DataFrame:
    """Month-over-month revenue change, and revenue against the month's median over all cities."""
    by_month = Window.partitionBy("city").orderBy("month")
    all_cities = Window.partitionBy("month")
    previous = F.lag("total_revenue").over(by_month)
    change = ratio(
        F.col("total_revenue") - F.col("previous_revenue"), F.col("previous_revenue"), otherwise=None
    )
    to_median = ratio(F.col("total_revenue"), F.col("median_revenue"), otherwise=None)
    return (
        locations.revenue_trend(wh, None, months)
        .withColumn("previous_revenue", previous)
        .withColumn("median_revenue", F.median("total_revenue").over(all_cities))
        .select(
            "city", "month", "total_revenue", "previous_revenue",
            (change * 100).alias("change_pct"),
            to_median.alias("ratio_to_median"),
            F.coalesce(to_median >= OUTLIER_RATIO, F.lit(False)).alias("is_outlier"),
        )
        .transform(fixed(change_pct=2, ratio_to_median=2))
        .orderBy("city", "month")
    )


def margin_trend(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Margin per location and month with its change, and months whose labour exceeds revenue."""
    by_month = Window.partitionBy("location_id").orderBy("month")
    change = F.col("margin_pct") - F.lag("margin_pct").over(by_month)
    return (
        finance.pnl_by_location(wh, city, months)
        .select(
            "city", "month", "revenue", "labor_cost", "profit", "margin_pct",
            change.alias("margin_change"),
            (F.col("labor_cost") > F.col("revenue")).alias("labor_above_revenue"),
        )
        .transform(fixed(margin_change=2))
        .orderBy("city", "month")
    )


def loss_months(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Only the months in which labour alone costs more than the revenue."""
    return margin_trend(wh, city, months).where("labor_above_revenue")


def understaffing(wh: Warehouse, city: str | None = None, months: int = 6) -> DataFrame:
    """Monthly therapist hours asked for per therapist, cities without any therapist first."""
    hours = number("hours") / months
    therapists = whole("therapist_headcount")
    return (
        _staff_by_city(wh, city)
        .join(_demand_by_city(wh, city, months), "city", "left")
        .select(
            "city",
            whole("booking_count").alias("booking_count"),
            hours.alias("monthly_therapist_hours"),
            therapists.alias("therapist_headcount"),
            "open_requisitions",
            ratio(hours, therapists, otherwise=None).alias("hours_per_therapist"),
            ((therapists == 0) & (hours > 0)).alias("demand_without_staff"),
        )
        .transform(fixed(monthly_therapist_hours=2, hours_per_therapist=2))
        .orderBy(F.desc("demand_without_staff"), F.desc_nulls_last("hours_per_therapist"), "city")
    )


def room_payback(
    wh: Warehouse, room_cost: float, city: str | None = None, months: int = 6
) -> DataFrame:
    """Months until a further treatment room has earned its cost; NULL where rooms earn nothing."""
    cost = F.lit(_non_negative("room_cost", room_cost))
    per_room = F.col("avg_monthly_revenue_per_room")
    return finance.revenue_per_room(wh, city, months).withColumn(
        "payback_months", ratio(cost, per_room, otherwise=None)
    ).transform(fixed(payback_months=1))


def capacity_pressure(wh: Warehouse, city: str | None = None) -> DataFrame:
    """Forecast load of each location's capacity, and the first month that fills it."""
    capacity = F.col("monthly_capacity")
    load = ratio(F.col("predicted_bookings"), capacity, otherwise=None) * 100
    upper = ratio(F.col("upper_bound"), capacity, otherwise=None) * 100
    is_full = (capacity > 0) & (F.col("predicted_bookings") >= capacity)
    full = F.when(is_full, F.col("forecast_month"))
    return (
        locations.forecast_by_location(wh, city)
        .groupBy("location_id", "city", "monthly_capacity")
        .agg(
            F.max(load).alias("load"), F.max(upper).alias("upper"),
            F.min(full).alias("first_full_month"),
        )
        .select(
            "city", "monthly_capacity",
            F.col("load").alias("peak_load_pct"),
            F.col("upper").alias("peak_upper_load_pct"),
            "first_full_month",
        )
        .transform(fixed(peak_load_pct=1, peak_upper_load_pct=1))
        .orderBy(F.desc_nulls_last("peak_load_pct"), "city")
    )


def churn_against_visits(wh: Warehouse) -> DataFrame:
    """Risk cohorts with the correlation of churn probability and days since the last visit.

    The cohorts carry the sums the correlation of all customers is made of, so the table is read once.
    """
    x = F.when(F.col("days_since_last_visit").isNotNull(), F.col("churn_probability_pct")).cast(_EXACT)
    y = F.when(F.col("churn_probability_pct").isNotNull(), F.col("days_since_last_visit")).cast(_EXACT)
    moments = {
        "_n": F.count(x + y), "_x": F.sum(x), "_y": F.sum(y),
        "_xx": F.sum(x * x), "_yy": F.sum(y * y), "_xy": F.sum(x * y),
    }
    everyone = Window.partitionBy()  # one row for each cohort
    n, sx, sy, sxx, syy, sxy = (F.sum(name).over(everyone).cast("double") for name in moments)
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    cohorts = health.churn_cohorts(wh, "churnRisk", moments)
    return (
        cohorts.withColumn("churn_visit_correlation", F.when(spread > 0, (n * sxy - sx * sy) / spread))
        .drop(*moments)
        .transform(fixed(churn_visit_correlation=4))
        .orderBy(F.asc_nulls_last("group_value"))
    )


def overtime_saving(
    wh: Warehouse, cut_pct: float, city: str | None = None, months: int = 6
) -> DataFrame:
    """What cutting overtime by ``cut_pct`` percent would have saved over the window."""
    share = _non_negative("cut_pct", cut_pct) / 100
    return (
        finance.labor_cost_by_role(wh, city, months)
        .groupBy("city")
        .agg(F.sum(money("overtime_cost")).alias("overtime"))
        .select(
            "city",
            number("overtime").alias("overtime_cost"),
            (number("overtime") * share).alias("saving"),
        )
        .transform(fixed(saving=2))
        .orderBy("city")
    )


def staffing_against_churn(wh: Warehouse) -> DataFrame:
    """Churn and staffing side by side per city."""
    return (
        health.churn_by_location(wh)
        .join(_staff_by_city(wh), "city")
        .select(
            "city", "customer_count", "avg_churn_probability_pct", "high_churn_risk_pct",
            "active_headcount", "therapist_headcount",
            ratio(F.col("customer_count"), F.col("therapist_headcount"), otherwise=None).alias(
                "customers_per_therapist"
            ),
        )
        .transform(fixed(customers_per_therapist=1))
        .orderBy("city")
    )


def cost_gap(wh: Warehouse, city: str, other_city: str, months: int = 6) -> DataFrame:
    """Labour roles and cost categories of two cities, largest difference first."""
    required_text("city", city)
    required_text("other_city", other_city)

    def long_form(report: DataFrame, kind: str, item: str, amount: str) -> DataFrame:
        return report.select(
            "city", F.lit(kind).alias("cost_type"), F.col(item).alias("item"),
            F.col(amount).alias("amount"),
        )

    def of(name: str) -> Column:
        return F.sum(F.when(F.col("city") == name, F.col("amount")).otherwise(0.0))

    both = (city, other_city)
    costs = long_form(
        finance.labor_by_role(wh, both, months), "labor", "role", "total_labor_cost"
    ).unionByName(
        long_form(finance.costs_by_category(wh, both, months), "operations", "cost_category", "amount")
    )
    return (
        costs.groupBy("cost_type", "item")
        .agg(of(city).alias("amount"), of(other_city).alias("other_amount"))
        .withColumn("difference", F.col("amount") - F.col("other_amount"))
        .transform(fixed(difference=2))
        .orderBy(F.desc(F.abs("difference")), "cost_type", "item")
    )


def quarterly_demand(wh: Warehouse, city: str | None = None, months: int = 24) -> DataFrame:
    """Bookings by quarter and their growth; ``months_covered`` tells partial quarters."""
    by_quarter = Window.partitionBy("city").orderBy("quarter")
    previous = F.lag("booking_count").over(by_quarter)
    growth = ratio(F.col("booking_count") - F.col("previous"), F.col("previous"), otherwise=None)
    return (
        workforce.booking_demand(wh, city, months)
        .groupBy("city", F.trunc("month", "quarter").alias("quarter"))
        .agg(
            F.sum("booking_count").alias("booking_count"),
            F.sum(money("therapist_hours_required")).alias("hours"),
            F.count("*").alias("months_covered"),
        )
        .withColumn("previous", previous)
        .select(
            "city", "quarter", "booking_count",
            number("hours").alias("therapist_hours_required"),
            "months_covered",
            (growth * 100).alias("growth_pct"),
        )
        .transform(fixed(growth_pct=1))
        .orderBy("city", "quarter")
    )


def hiring_plan(wh: Warehouse, months: int = 6) -> DataFrame:
    """Staff for cities where nobody works, after the cities that have therapists.

    Headcount follows the mean of the staffed cities. Therapists follow the city's own monthly hours
    at the hours a therapist carries elsewhere, or the mean where there is no demand yet.
    """
    bounded_int("months", months, 1, workforce.MAX_MONTHS)
    cities = _staff_by_city(wh).join(_demand_by_city(wh, None, months), "city", "left")
    # a window over one row for each city, so that staffing and demand are worked out once
    everywhere = Window.partitionBy()
    staffed = F.col("therapist_headcount") > 0

    def over_staffed(total: Column) -> Column:
        return F.sum(F.when(staffed, total)).over(everywhere)

    therapists = over_staffed(F.col("therapist_headcount"))
    count = over_staffed(F.lit(1))
    mean_heads = ratio(over_staffed(F.col("active_headcount")), count)
    mean_therapists = ratio(therapists, count)
    load = ratio(F.coalesce(over_staffed(F.col("hours")).cast("double"), F.lit(0.0)) / months, therapists)
    hours = number("hours") / months
    return (
        cities.select(
            "city", "active_headcount",
            hours.alias("monthly_therapist_hours"),
            "open_requisitions",
            mean_heads.alias("heads"), mean_therapists.alias("therapists"), load.alias("load"),
            hours.alias("own_hours"),
        )
        .where("active_headcount = 0")
        .select(
            "city", "monthly_therapist_hours", "open_requisitions",
            F.col("heads").alias("comparable_headcount"),
            F.col("load").alias("comparable_hours_per_therapist"),
            F.ceil(
                F.when(
                    (F.col("own_hours") > 0) & (F.col("load") > 0),
                    F.col("own_hours") / F.col("load"),
                ).otherwise(F.col("therapists"))
            ).alias("suggested_therapists"),
        )
        .transform(
            fixed(
                monthly_therapist_hours=2, comparable_headcount=1, comparable_hours_per_therapist=2
            )
        )
        .orderBy("city")
    )
