"""Customer lookups in bulk: name search, profile, renewal, offer, activity and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.functions.rules import flag, number, whole
from memberlens.operators.lookup import find, top_per_key
from memberlens.operators.name_match import match_names
from memberlens.params import bounded_int, positive_ids, required_text
from memberlens.schemas import TABLES
from memberlens.sources.warehouse import Warehouse

SEARCH_LIMIT = 20
DEFAULT_ACTIVITY = 5
MAX_ACTIVITY = 20
# numbers of the activity table that stay NULL when missing
_NULLABLE = {"campaign_id"}


def customer_ids(spark: SparkSession, ids) -> DataFrame:
    """Ids given by hand as a frame for the lookups below."""
    rows = [(value,) for value in positive_ids("ids", ids)]
    return spark.createDataFrame(rows, "customer_id long")


def name_queries(spark: SparkSession, queries) -> DataFrame:
    """Search texts given by hand, numbered from one."""
    rows = [(i, required_text("name_query", q)) for i, q in enumerate(queries, start=1)]
    return spark.createDataFrame(rows, "query_id long, name_query string")


def _edge(table: str) -> list[Column]:
    """Declared columns with missing numbers as zero and missing booleans as false."""
    casts = {T.LongType: whole, T.DecimalType: number, T.BooleanType: flag}
    columns = []
    for field in TABLES[table].fields:
        cast = casts.get(type(field.dataType))
        if field.name in _NULLABLE:
            columns.append(F.col(field.name).cast("long").alias(field.name))
        elif cast:
            columns.append(cast(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return columns


def _lookup(wh: Warehouse, table: str, ids: DataFrame, order: list[Column]) -> DataFrame:
    rows = wh.table(table).select(*_edge(table))
    names = TABLES[table].fieldNames()
    return find(ids, rows, "customer_id", order).select(*names, "found")


def search_customers(wh: Warehouse, queries: DataFrame) -> DataFrame:
    """Customers whose full name contains a query, at most 20 per query, lowest id first."""
    full_name = F.concat("first_name", F.lit(" "), "last_name")
    people = wh.table("customers", ["customer_id", "first_name", "last_name"])
    hits = match_names(queries, people, full_name, "customer_id", SEARCH_LIMIT)
    # only the few hits fetch the wide profile
    profiles = wh.table("customers").select(*_edge("customers"))
    return (
        hits.select("query_id", "customer_id")
        .join(profiles, "customer_id")
        .select("query_id", *TABLES["customers"].fieldNames())
    )


def _rest(table: str, first: str) -> list:
    """All other columns of a table, so that an order is total but for equal rows."""
    return [F.asc_nulls_last(name) for name in TABLES[table].fieldNames() if name != first]


def customer_profiles(wh: Warehouse, ids: DataFrame) -> DataFrame:
    """Full profile per id."""
    return _lookup(wh, "customers", ids, [F.desc_nulls_last("join_date"), *_rest("customers", "join_date")])


def customer_renewals(wh: Warehouse, ids: DataFrame) -> DataFrame:
    """Latest renewal per id."""
    return _lookup(
        wh, "renewals", ids, [F.desc_nulls_last("renewal_date"), F.desc("renewal_id")]
    )


def upgrade_offers(wh: Warehouse, ids: DataFrame) -> DataFrame:
    """Upgrade offer per id; most customers have none."""
    return _lookup(
        wh, "upgrade_offers", ids, [F.desc_nulls_last("renewal_date"), *_rest("upgrade_offers", "renewal_date")]
    )


def customer_health(wh: Warehouse, ids: DataFrame) -> DataFrame:
    """Predicted tier, churn risk and value per id."""
    return _lookup(
        wh, "customer_tiers", ids,
        [F.desc_nulls_last("churn_probability_pct"), *_rest("customer_tiers", "churn_probability_pct")],
    )


def recent_activity(wh: Warehouse, ids: DataFrame, limit: int = DEFAULT_ACTIVITY) -> DataFrame:
    """The latest membership events of every id, newest first."""
    bounded_int("limit", limit, 1, MAX_ACTIVITY)
    wanted = ids.select("customer_id").distinct()
    history = wh.table("membership_history").join(wanted, "customer_id", "left_semi")
    newest = [F.desc_nulls_last("event_date"), F.desc("event_id")]
    return top_per_key(history, "customer_id", newest, limit).select(*_edge("membership_history"))
