"""Churn cohorts and churn by home location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.rules import fixed, mean, number, percent, whole
from memberlens.operators.rollup import totals_by_city
from memberlens.params import one_of
from memberlens.sources.warehouse import Warehouse

GROUP_COLUMNS = {"tier": "membership_type", "churnRisk": "churn_risk"}
# report column -> (table column, decimals)
_COHORT_MEANS = {
    "avg_ltv": ("predicted_ltv_12m", 2),
    "avg_churn_probability_pct": ("churn_probability_pct", 1),
    "avg_visit_frequency_monthly": ("visit_frequency_monthly", 2),
    "avg_days_since_last_visit": ("days_since_last_visit", 1),
    "avg_nps_score": ("nps_score", 1),
}


def churn_cohorts(
    wh: Warehouse, group_by: str, more: dict[str, Column] | None = None
) -> DataFrame:
    """Health means by paid membership (``tier``) or by predicted risk (``churnRisk``).

    ``more`` adds aggregates of the measured columns to every cohort.
    """
    more = more or {}
    key = GROUP_COLUMNS[one_of("group_by", group_by, tuple(GROUP_COLUMNS))]
    measured = [column for column, _ in _COHORT_MEANS.values()]
    sums = [F.sum(c).alias(f"{c}_sum") for c in measured]
    counts = [F.count(c).alias(f"{c}_rows") for c in measured]
    totals = (
        wh.table("customer_tiers", [key, *measured])
        .groupBy(F.col(key).alias("group_value"))
        .agg(
            F.count("*").alias("customer_count"), *sums, *counts,
            *[column.alias(name) for name, column in more.items()],
        )
    )
    means = [
        number(mean(F.col(f"{column}_sum"), F.col(f"{column}_rows"))).alias(name)
        for name, (column, _) in _COHORT_MEANS.items()
    ]
    digits = {name: places for name, (_, places) in _COHORT_MEANS.items()}
    return (
        totals.select("group_value", "customer_count", *means, *more)
        .transform(fixed(**digits))
        .orderBy(F.asc_nulls_last("group_value"))
    )


def churn_by_location(wh: Warehouse) -> DataFrame:
    """Churn by the city of the customer's home location."""
    members = wh.table(
        "customer_tiers", ["home_location_id", "churn_probability_pct", "churn_risk"]
    ).withColumnRenamed("home_location_id", "location_id")
    high = F.when(F.col("churn_risk") == "High", 1).otherwise(0)
    totals = totals_by_city(
        members, wh.sites(None), None, [],
        customer_count=F.count("*"), high_churn_risk_count=F.sum(high),
        churn_sum=F.sum("churn_probability_pct"), churn_rows=F.count("churn_probability_pct"),
    )
    return totals.select(
        "city",
        whole("customer_count").alias("customer_count"),
        number(mean(F.col("churn_sum"), F.col("churn_rows"))).alias(
            "avg_churn_probability_pct"
        ),
        whole("high_churn_risk_count").alias("high_churn_risk_count"),
        percent(whole("high_churn_risk_count"), whole("customer_count")).alias(
            "high_churn_risk_pct"
        ),
    ).transform(fixed(avg_churn_probability_pct=1, high_churn_risk_pct=1)).orderBy("city")
