"""Campaign performance and the health of campaign audiences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.rules import (
    fixed, mean, money, number, percent, ratio, shared_money, whole,
)
from memberlens.params import optional_text
from memberlens.sources.warehouse import Warehouse

AT_RISK = ["At Risk", "Unlikely"]


def campaign_performance(wh: Warehouse, channel: str | None = None) -> DataFrame:
    """Budget, conversions and revenue by channel; cost per acquisition is NULL without any."""
    optional_text("channel", channel)
    campaigns = wh.table(
        "campaigns", ["channel", "budget", "total_converted", "revenue_attributed"]
    )
    if channel:
        campaigns = campaigns.where(F.col("channel") == channel)
    totals = campaigns.groupBy("channel").agg(
        F.sum(money("budget")).alias("budget"),
        F.sum("total_converted").alias("converted"),
        F.sum(shared_money("revenue_attributed")).alias("revenue"),
    )
    cost = ratio(number("budget"), whole("converted"), otherwise=None)
    return totals.select(
        "channel",
        number("budget").alias("total_budget"),
        whole("converted").alias("total_converted"),
        number("revenue").alias("total_revenue_attributed"),
        cost.alias("cost_per_acquisition"),
    ).transform(fixed(cost_per_acquisition=2)).orderBy("channel")


def campaign_retention(wh: Warehouse) -> DataFrame:
    """Renewal risk and churn of the distinct responders of each campaign.

    Campaigns that share a name are one row, which may count a customer once per campaign. A customer
    without a renewal counts as not at risk, and one with two renewals or two health rows counts
    twice. Responders are added up per campaign before the campaign table is joined, so a campaign
    that drew most responses is one row by then.
    """
    responders = wh.table("campaign_responses").dropDuplicates(["campaign_id", "customer_id"])
    renewals = wh.table("renewals", ["customer_id", "renewal_likelihood"])
    health = wh.table("customer_tiers", ["customer_id", "churn_probability_pct"])
    at_risk = F.when(F.col("renewal_likelihood").isin(AT_RISK), 1).otherwise(0)
    per_campaign = (
        responders.join(renewals, "customer_id", "left")
        .join(health, "customer_id", "left")
        .groupBy("campaign_id")
        .agg(
            F.count("*").alias("responders"),
            F.sum(at_risk).alias("at_risk"),
            F.sum("churn_probability_pct").alias("churn_sum"),
            F.count("churn_probability_pct").alias("churn_rows"),
        )
    )
    totals = (
        per_campaign.join(wh.table("campaigns", ["campaign_id", "campaign_name"]), "campaign_id")
        .groupBy("campaign_name")
        .agg(*[F.sum(c).alias(c) for c in ("responders", "at_risk", "churn_sum", "churn_rows")])
        .withColumn("churn", mean(F.col("churn_sum"), F.col("churn_rows")))
    )
    # campaigns without any health record sort last although they show zero
    return totals.orderBy(F.asc_nulls_last("churn"), "campaign_name").select(
        "campaign_name",
        whole("responders").alias("responded_customer_count"),
        whole("at_risk").alias("at_risk_or_unlikely_renewal_count"),
        percent(whole("at_risk"), whole("responders")).alias(
            "at_risk_or_unlikely_renewal_pct"
        ),
        number("churn").alias("avg_churn_probability_pct"),
    ).transform(fixed(at_risk_or_unlikely_renewal_pct=1, avg_churn_probability_pct=1))
