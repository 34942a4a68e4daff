"""The sixteen warehouse tables: columns, month columns and allowed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)
_TYPES = {
    "long": T.LongType(),
    "text": T.StringType(),
    "date": T.DateType(),
    "money": _MONEY,
    "flag": T.BooleanType(),
    "variant": T.VariantType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "customers": _table(
        customer_id="long", first_name="text", last_name="text", email="text", phone="text",
        home_location_id="long", join_date="date", last_visit_date="date", total_visits="long",
        lifetime_spend="money", avg_spend_per_visit="money", preferred_service="text",
        membership_type="text", referral_source="text", nps_score="long",
        days_since_last_visit="long", visit_frequency_monthly="money", address="text",
        is_active="flag",
    ),
    "renewals": _table(
        renewal_id="long", customer_id="long", current_tier="text", home_location_id="long",
        renewal_date="date", total_visits="long", visit_frequency_monthly="money",
        days_since_last_visit="long", nps_score="long", lifetime_spend="money",
        renewal_probability_pct="money", renewal_likelihood="text", upgrade_candidate="flag",
    ),
    "upgrade_offers": _table(
        customer_id="long", first_name="text", last_name="text", current_tier="text",
        recommended_tier="text", visit_frequency_monthly="money", lifetime_spend="money",
        preferred_service="text", renewal_date="date", ai_upgrade_pitch="text",
    ),
    "membership_history": _table(
        event_id="long", customer_id="long", event_date="date", event_type="text",
        from_tier="text", to_tier="text", trigger_source="text", campaign_id="long",
    ),
    "customer_tiers": _table(
        customer_id="long", first_name="text", last_name="text", home_location_id="long",
        lifetime_spend="money", total_visits="long", visit_frequency_monthly="money",
        days_since_last_visit="long", nps_score="long", membership_type="text",
        preferred_service="text", ai_tier="text", churn_risk="text",
        churn_probability_pct="money", predicted_ltv_12m="money", ai_recommendation="text",
    ),
    "location_master": _table(
        location_id="long", city="text", treatment_rooms="long", monthly_capacity="long",
    ),
    "bookings": _table(
        location_id="long", booking_month="date", service_type="text", booking_count="long",
        revenue="money", refund_count="long", refund_amount="money",
        therapist_hours_required="money",
    ),
    "labor_costs": _table(
        location_id="long", month="date", role="text", headcount="long",
        total_labor_cost="money", overtime_cost="money",
    ),
    "operational_costs": _table(
        location_id="long", month="date", cost_category="text", amount="money",
    ),
    "employees": _table(
        location_id="long", role="text", employment_status="text", hire_date="date",
        termination_date="date", compensation_annual="money",
    ),
    "requisitions": _table(
        location_id="long", role="text", status="text", headcount_requested="long",
        posted_date="date", filled_date="date",
    ),
    "recruiting_costs": _table(location_id="long", month="date", amount="money"),
    "campaigns": _table(
        campaign_id="long", campaign_name="text", channel="text", budget="money",
        total_converted="long", revenue_attributed="money",
    ),
    "campaign_responses": _table(campaign_id="long", customer_id="long"),
    "forecast_bookings": _table(
        city="variant", forecast_month="date", predicted_bookings="money", lower_bound="money",
        upper_bound="money",
    ),
    "forecast_attrition": _table(
        city="variant", forecast_month="date", predicted_terminations="money",
        worst_case_terminations="money",
    ),
}

# The column whose table-wide maximum ends every look-back window.
MONTH_COLUMNS = {
    "bookings": "booking_month",
    "labor_costs": "month",
    "operational_costs": "month",
    "recruiting_costs": "month",
}

# The closed string sets of the data model.
ALLOWED_VALUES = {
    ("renewals", "renewal_likelihood"): ["At Risk", "Moderate", "Unlikely", "Very Likely"],
    ("membership_history", "event_type"): [
        "Signup", "Upgrade", "Downgrade", "Renewal", "Cancellation",
    ],
    ("customer_tiers", "ai_tier"): ["Bronze", "Silver", "Gold", "Platinum"],
    ("customer_tiers", "churn_risk"): ["High", "Medium", "Low"],
}


def enumerated_values(warehouse) -> DataFrame:
    """Row counts of every value in the closed columns, telling which values are not allowed."""
    counts = [
        warehouse.table(table, [column])
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("row_count"))
        .select(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            "value",
            "row_count",
            F.coalesce(F.col("value").isin(values), F.lit(False)).alias("is_allowed"),
        )
        for (table, column), values in ALLOWED_VALUES.items()
    ]
    return reduce(DataFrame.unionByName, counts)
