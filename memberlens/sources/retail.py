"""The sixteen tables derived from a retail star schema (orders, line items, events, ...).

The star schema holds no spa, payroll or recruiting data, so the rules below are stand-ins. They
keep the grain, the types and the gaps of the real tables: customers without a renewal or a health
score, locations that have not opened, months with costs but no bookings and the other way round.
Facts stay at line, order or event grain wherever the reports only add them up; then a report is one
scan, its dimension joins and one partial aggregation. Facts keep rows with an unknown dimension key,
so the latest month of a table is the latest date of the source column alone.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.functions.rules import money, month_of
from memberlens.schemas import TABLES
from memberlens.sources.warehouse import Lookback, Warehouse

# Fixed values of the stand-in rules.
AS_OF = date(2001, 12, 1)
CAPACITY_PER_ROOM = 8
PLANNED_SITE_OFFSET = 1000
WAGE_SHARE = Decimal("0.4")
OVERTIME_SHARE = Decimal("0.1")
RECRUITING_SHARE = Decimal("0.02")
VISITS_PER_MONTH = Decimal("0.0125")
LTV_SHARE = Decimal("0.15")
ROLE_BY_PRIORITY = {
    "1-URGENT": "Lead Therapist",
    "2-HIGH": "Therapist",
    "3-MEDIUM": "Front Desk",
    "4-NOT SPECIFIED": "Manager",
    "5-LOW": "Attendant",
}
EMPLOYMENT_BY_STATUS = {"O": "Active", "F": "Terminated", "P": "Leave"}
REQUISITION_BY_STATUS = {"O": "Open", "F": "Filled", "P": "Cancelled"}
MEMBERSHIP_EVENT_BY_TYPE = {
    "signup": "Signup",
    "purchase": "Upgrade",
    "error": "Downgrade",
    "click": "Renewal",
    "view": "Cancellation",
}
CAMPAIGN_EVENTS = ["click", "purchase"]

# Declared so that opening a table reads no file.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}

_DATE_COLUMNS = {
    "bookings": ("lineitem", "l_shipdate"),
    "labor_costs": ("orders", "o_orderdate"),
    "operational_costs": ("lineitem", "l_shipdate"),
    "recruiting_costs": ("orders", "o_orderdate"),
}


def _mapped(column: str, values: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for source, target in reversed(values.items()):
        chosen = F.when(F.col(column) == source, target).otherwise(chosen)
    return chosen


def _long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the star schema."""
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


class RetailWarehouse(Warehouse):
    """Derives every table on the fly from the star schema in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder

    def source(self, name: str) -> DataFrame:
        return read_star(self.spark, self.folder, name)

    def _load(self, name: str, columns: list[str]) -> DataFrame:
        return self._derive(name, columns, None)

    def lookback(self, name: str, months: int) -> Lookback:
        source, column = _DATE_COLUMNS[name]
        latest = self.source(source).agg(month_of(F.max(column)).alias("latest"))
        return Lookback(latest, months)

    def rows(self, name: str, columns: list[str], window: Lookback) -> DataFrame:
        return self._derive(name, columns, window.first_day()).select(*columns)

    def _derive(self, name: str, columns: list[str], since: Column | None) -> DataFrame:
        build = getattr(self, f"_{name}")
        frame = build(columns, since) if name in _DATE_COLUMNS else build(columns)
        missing = [
            F.lit(None).cast(field.dataType).alias(field.name)
            for field in TABLES[name].fields
            if field.name in columns and field.name not in frame.columns
        ]
        return frame.select("*", *missing) if missing else frame

    def _dated(self, name: str, since: Column | None) -> DataFrame:
        source, column = _DATE_COLUMNS[name]
        frame = self.source(source)
        return frame if since is None else frame.where(F.col(column) >= since)

    # -- locations ---------------------------------------------------------------------------

    def _location_master(self, columns: list[str]) -> DataFrame:
        nation = self.source("nation").select(
            _long("n_nationkey").alias("location_id"), F.col("n_name").alias("city")
        )
        if {"treatment_rooms", "monthly_capacity"} & set(columns):
            rooms = (
                self.source("supplier")
                .groupBy(_long("s_nationkey").alias("location_id"))
                .agg(F.count("*").alias("treatment_rooms"))
            )
            nation = nation.join(rooms, "location_id", "left")
        else:
            nation = nation.withColumn("treatment_rooms", F.lit(None).cast("long"))
        planned = self.source("region").select(
            (_long("r_regionkey") + PLANNED_SITE_OFFSET).alias("location_id"),
            F.col("r_name").alias("city"),
            _long(F.lit(0)).alias("treatment_rooms"),
        )
        sites = nation.unionByName(planned).withColumn(
            "treatment_rooms", F.coalesce("treatment_rooms", _long(F.lit(0)))
        )
        return sites.withColumn("monthly_capacity", F.col("treatment_rooms") * CAPACITY_PER_ROOM)

    def _with_supplier_location(self, lines: DataFrame) -> DataFrame:
        suppliers = self.source("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), _long("s_nationkey").alias("location_id")
        )
        return lines.join(suppliers, "l_suppkey", "left")

    def _with_part(self, lines: DataFrame, column: str, alias: str) -> DataFrame:
        parts = self.source("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col(column).alias(alias)
        )
        return lines.join(parts, "l_partkey", "left")

    def _with_customer_location(self, orders: DataFrame) -> DataFrame:
        homes = self.source("customer").select(
            F.col("c_custkey").alias("o_custkey"), _long("c_nationkey").alias("location_id")
        )
        return orders.join(homes, "o_custkey", "left")

    # -- monthly facts -----------------------------------------------------------------------

    def _bookings(self, columns: list[str], since: Column | None) -> DataFrame:
        lines = self._dated("bookings", since)
        if "location_id" in columns:
            lines = self._with_supplier_location(lines)
        if "service_type" in columns:
            lines = self._with_part(lines, "p_type", "service_type")
        refunded = F.col("l_returnflag") == "R"
        price = money("l_extendedprice")
        return lines.select(
            *[c for c in ("location_id", "service_type") if c in lines.columns],
            month_of("l_shipdate").alias("booking_month"),
            _long(F.lit(1)).alias("booking_count"),
            price.alias("revenue"),
            _long(F.when(refunded, 1).otherwise(0)).alias("refund_count"),
            F.when(refunded, price).otherwise(money(F.lit(0))).alias("refund_amount"),
            money("l_quantity").alias("therapist_hours_required"),
        )

    def _labor_costs(self, columns: list[str], since: Column | None) -> DataFrame:
        price = money("o_totalprice")
        overtime = F.when(F.col("o_orderstatus") == "P", price).otherwise(money(F.lit(0)))
        # the headcount is a distinct count: Spark groups by key and customer first, so a hot
        # location or month is spread over its customers before the final count
        return (
            self._with_customer_location(self._dated("labor_costs", since))
            .groupBy(
                "location_id",
                month_of("o_orderdate").alias("month"),
                _mapped("o_orderpriority", ROLE_BY_PRIORITY).alias("role"),
            )
            .agg(
                F.count_distinct("o_custkey").alias("headcount"),
                (F.sum(price) * F.lit(WAGE_SHARE)).alias("total_labor_cost"),
                (F.sum(overtime) * F.lit(OVERTIME_SHARE)).alias("overtime_cost"),
            )
        )

    def _operational_costs(self, columns: list[str], since: Column | None) -> DataFrame:
        lines = self._dated("operational_costs", since)
        if "location_id" in columns:
            lines = self._with_supplier_location(lines)
        if "cost_category" in columns:
            lines = self._with_part(lines, "p_brand", "cost_category")
        return lines.select(
            *[c for c in ("location_id", "cost_category") if c in lines.columns],
            month_of("l_shipdate").alias("month"),
            (money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("amount"),
        )

    def _recruiting_costs(self, columns: list[str], since: Column | None) -> DataFrame:
        return self._with_customer_location(self._dated("recruiting_costs", since)).select(
            "location_id",
            month_of("o_orderdate").alias("month"),
            (money("o_totalprice") * F.lit(RECRUITING_SHARE)).alias("amount"),
        )

    # -- customers ---------------------------------------------------------------------------

    def _customers(self, columns: list[str]) -> DataFrame:
        visits = (
            self.source("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(
                F.min("o_orderdate").cast("date").alias("join_date"),
                F.max("o_orderdate").cast("date").alias("last_visit_date"),
                F.count("*").alias("total_visits"),
                F.sum(money("o_totalprice")).alias("lifetime_spend"),
            )
        )
        name = F.split("c_name", "#")
        return (
            self.source("customer")
            .join(visits, "c_custkey", "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.get(name, 0).alias("first_name"),
                F.get(name, 1).alias("last_name"),
                _long("c_nationkey").alias("home_location_id"),
                "join_date",
                "last_visit_date",
                "total_visits",
                "lifetime_spend",
                (F.col("lifetime_spend").cast("double") / F.col("total_visits")).alias(
                    "avg_spend_per_visit"
                ),
                F.col("c_mktsegment").alias("membership_type"),
                _long(
                    F.greatest(F.floor(F.col("c_acctbal") / 1000) + 1, F.lit(0))
                ).alias("nps_score"),
                _long(F.datediff(F.lit(AS_OF), "last_visit_date")).alias("days_since_last_visit"),
                (F.col("total_visits").cast("decimal(18,0)") * F.lit(VISITS_PER_MONTH)).alias(
                    "visit_frequency_monthly"
                ),
                (F.col("c_acctbal") >= 0).alias("is_active"),
            )
        )

    def _scored(self) -> DataFrame:
        """Customers with a churn probability; scores need a visit."""
        return self._customers([]).where("total_visits is not null").withColumn(
            "churn_probability_pct",
            _long(F.least(F.lit(99), F.floor(F.col("days_since_last_visit") / 8))),
        )

    def _customer_tiers(self, columns: list[str]) -> DataFrame:
        churn = F.col("churn_probability_pct")
        spend = F.col("lifetime_spend")
        return (
            self._scored()
            .select(
                "customer_id", "first_name", "last_name", "home_location_id", "lifetime_spend",
                "total_visits", "visit_frequency_monthly", "days_since_last_visit", "nps_score",
                "membership_type",
                F.when(spend >= 4000000, "Platinum")
                .when(spend >= 2500000, "Gold")
                .when(spend >= 1500000, "Silver")
                .otherwise("Bronze")
                .alias("ai_tier"),
                F.when(churn >= 60, "High")
                .when(churn >= 30, "Medium")
                .otherwise("Low")
                .alias("churn_risk"),
                "churn_probability_pct",
                (spend * F.lit(LTV_SHARE)).alias("predicted_ltv_12m"),
            )
        )

    def _renewals(self, columns: list[str]) -> DataFrame:
        probability = 100 - F.col("churn_probability_pct")
        return (
            self._scored()
            .where("is_active")
            .select(
                F.col("customer_id").alias("renewal_id"),
                "customer_id",
                F.col("membership_type").alias("current_tier"),
                "home_location_id",
                F.date_add("last_visit_date", 365).alias("renewal_date"),
                "total_visits", "visit_frequency_monthly", "days_since_last_visit", "nps_score",
                "lifetime_spend",
                probability.alias("renewal_probability_pct"),
                F.when(probability < 25, "Unlikely")
                .when(probability < 50, "At Risk")
                .when(probability < 75, "Moderate")
                .otherwise("Very Likely")
                .alias("renewal_likelihood"),
                (F.col("nps_score") >= 9).alias("upgrade_candidate"),
            )
        )

    def _upgrade_offers(self, columns: list[str]) -> DataFrame:
        return (
            self._scored()
            .where("is_active and nps_score >= 9 and churn_probability_pct < 50")
            .select(
                "customer_id", "first_name", "last_name",
                F.col("membership_type").alias("current_tier"),
                "visit_frequency_monthly", "lifetime_spend",
                F.date_add("last_visit_date", 365).alias("renewal_date"),
            )
        )

    def _membership_history(self, columns: list[str]) -> DataFrame:
        campaign = _long(F.get_json_object("props", "$.k"))
        return self.source("events").select(
            "event_id",
            F.col("user_id").alias("customer_id"),
            F.col("ts").cast("date").alias("event_date"),
            _mapped("event_type", MEMBERSHIP_EVENT_BY_TYPE).alias("event_type"),
            F.when(F.col("event_type").isin(CAMPAIGN_EVENTS), campaign).alias("campaign_id"),
        )

    # -- staff -------------------------------------------------------------------------------

    def _employees(self, columns: list[str]) -> DataFrame:
        hired = F.col("o_orderdate").cast("date")
        served = F.floor(F.col("o_totalprice") / 1000).cast("int")
        return self._with_customer_location(self.source("orders")).select(
            "location_id",
            _mapped("o_orderpriority", ROLE_BY_PRIORITY).alias("role"),
            _mapped("o_orderstatus", EMPLOYMENT_BY_STATUS).alias("employment_status"),
            hired.alias("hire_date"),
            F.when(F.col("o_orderstatus") == "F", F.date_add(hired, served)).alias(
                "termination_date"
            ),
            money("o_totalprice").alias("compensation_annual"),
        )

    def _requisitions(self, columns: list[str]) -> DataFrame:
        posted = F.col("o_orderdate").cast("date")
        waited = F.floor(F.col("o_totalprice") / 10000).cast("int")
        return self._with_customer_location(self.source("orders")).select(
            "location_id",
            _mapped("o_orderpriority", ROLE_BY_PRIORITY).alias("role"),
            _mapped("o_orderstatus", REQUISITION_BY_STATUS).alias("status"),
            _long(F.floor(F.col("o_totalprice") / 100000) + 1).alias("headcount_requested"),
            posted.alias("posted_date"),
            F.when(F.col("o_orderstatus") == "F", F.date_add(posted, waited)).alias("filled_date"),
        )

    # -- campaigns ---------------------------------------------------------------------------

    def _campaigns(self, columns: list[str]) -> DataFrame:
        price = money("p_retailprice")
        return self.source("part").select(
            F.col("p_partkey").alias("campaign_id"),
            F.col("p_name").alias("campaign_name"),
            F.col("p_type").alias("channel"),
            price.alias("budget"),
            # one channel without conversions, whose cost per acquisition is undefined
            _long(F.when(F.col("p_type") == "PROMO", 0).otherwise(F.col("p_size"))).alias(
                "total_converted"
            ),
            (price * F.col("p_size")).alias("revenue_attributed"),
        )

    def _campaign_responses(self, columns: list[str]) -> DataFrame:
        return self.source("events").where(F.col("event_type").isin(CAMPAIGN_EVENTS)).select(
            _long(F.get_json_object("props", "$.k")).alias("campaign_id"),
            F.col("user_id").alias("customer_id"),
        )

    # -- forecasts ---------------------------------------------------------------------------

    def _horizon(self, monthly: DataFrame, keys: list[str]) -> DataFrame:
        """Three future months per city, with the city as a VARIANT holding a JSON string."""
        return (
            monthly.join(self.sites(None), "location_id")
            .withColumn("ahead", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
            .select(
                F.parse_json(F.concat(F.lit('"'), "city", F.lit('"'))).alias("city"),
                F.add_months(F.col("latest"), F.col("ahead")).alias("forecast_month"),
                *keys,
            )
        )

    def _forecast_bookings(self, columns: list[str]) -> DataFrame:
        window = self.lookback("bookings", 12)
        monthly = (
            self.rows("bookings", ["location_id", "booking_month", "booking_count"], window)
            .groupBy("location_id", "booking_month")
            .agg(F.sum("booking_count").alias("n"))
            .groupBy("location_id")
            .agg(
                F.count("*").alias("months"),
                F.sum("n").alias("total"),
                F.sum(F.col("n") * F.col("n")).alias("squares"),
            )
        )
        total, months = F.col("total").cast("double"), F.col("months")
        spread = F.when(
            months > 1, F.sqrt((F.col("squares") - total * total / months) / (months - 1))
        ).otherwise(0.0)
        average = total / months
        stats = monthly.select(
            "location_id",
            # from the same bound as the filter: a second subquery would be merged with it into a
            # struct, which no longer reaches the scan
            F.add_months(window.first_day().cast("date"), 11).alias("latest"),
            average.alias("predicted_bookings"),
            F.greatest(average - spread * 1.96, F.lit(0.0)).alias("lower_bound"),
            (average + spread * 1.96).alias("upper_bound"),
        )
        return self._horizon(stats, ["predicted_bookings", "lower_bound", "upper_bound"])

    def _forecast_attrition(self, columns: list[str]) -> DataFrame:
        ended = self._employees([]).where("termination_date is not null")
        latest = ended.agg(month_of(F.max("termination_date")).alias("latest"))
        window = Lookback(latest, 12)
        monthly = (
            ended.withColumn("month", month_of("termination_date"))
            .where(F.col("month") > window.after())
            .groupBy("location_id", "month")
            .agg(F.count("*").alias("n"))
            .groupBy("location_id")
            .agg(
                (F.sum("n").cast("double") / F.count("*")).alias("predicted_terminations"),
                F.max("n").cast("double").alias("worst_case_terminations"),
            )
            .withColumn("latest", latest.scalar())
        )
        return self._horizon(monthly, ["predicted_terminations", "worst_case_terminations"])
