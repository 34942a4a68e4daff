"""Statements for the customer lookups."""

from __future__ import annotations

from oracles.tables import with_tables

_NUMBER, _WHOLE, _TEXT = "number", "whole", "text"
_MISSING = "missing"

_COLUMNS = {
    "customers": {
        "customer_id": _WHOLE, "first_name": _TEXT, "last_name": _TEXT, "email": _MISSING,
        "phone": _MISSING, "home_location_id": _WHOLE, "join_date": _TEXT, "last_visit_date": _TEXT,
        "total_visits": _WHOLE, "lifetime_spend": _NUMBER, "avg_spend_per_visit": _NUMBER,
        "preferred_service": _MISSING, "membership_type": _TEXT, "referral_source": _MISSING,
        "nps_score": _WHOLE, "days_since_last_visit": _WHOLE, "visit_frequency_monthly": _NUMBER,
        "address": _MISSING, "is_active": _TEXT,
    },
    "renewals": {
        "renewal_id": _WHOLE, "customer_id": _WHOLE, "current_tier": _TEXT,
        "home_location_id": _WHOLE, "renewal_date": _TEXT, "total_visits": _WHOLE,
        "visit_frequency_monthly": _NUMBER, "days_since_last_visit": _WHOLE, "nps_score": _WHOLE,
        "lifetime_spend": _NUMBER, "renewal_probability_pct": _NUMBER, "renewal_likelihood": _TEXT,
        "upgrade_candidate": _TEXT,
    },
    "upgrade_offers": {
        "customer_id": _WHOLE, "first_name": _TEXT, "last_name": _TEXT, "current_tier": _TEXT,
        "recommended_tier": _MISSING, "visit_frequency_monthly": _NUMBER,
        "lifetime_spend": _NUMBER, "preferred_service": _MISSING, "renewal_date": _TEXT,
        "ai_upgrade_pitch": _MISSING,
    },
    "customer_tiers": {
        "customer_id": _WHOLE, "first_name": _TEXT, "last_name": _TEXT,
        "home_location_id": _WHOLE, "lifetime_spend": _NUMBER, "total_visits": _WHOLE,
        "visit_frequency_monthly": _NUMBER, "days_since_last_visit": _WHOLE, "nps_score": _WHOLE,
        "membership_type": _TEXT, "preferred_service": _MISSING, "ai_tier": _TEXT,
        "churn_risk": _TEXT, "churn_probability_pct": _NUMBER, "predicted_ltv_12m": _NUMBER,
        "ai_recommendation": _MISSING,
    },
}

IDS = "SELECT p_partkey AS customer_id FROM part"

QUERIES = """
  SELECT 's' || s_suppkey AS query_id, 'eR ' || substring(s_name, 10, 8) AS name_query FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'c_st%00' || r_regionkey FROM region"""


def edge(table: str, alias: str, skip: tuple[str, ...] = ()) -> str:
    forms = {
        _NUMBER: "CASE WHEN {a}.customer_id IS NOT NULL THEN coalesce(CAST({a}.{c} AS DOUBLE), 0) END",
        _WHOLE: "CASE WHEN {a}.customer_id IS NOT NULL THEN coalesce(CAST({a}.{c} AS BIGINT), 0) END",
        _TEXT: "{a}.{c}",
        _MISSING: "CAST(NULL AS VARCHAR)",
    }
    return ", ".join(
        forms[kind].format(a=alias, c=name) + f" AS {name}"
        for name, kind in _COLUMNS[table].items()
        if name not in skip
    )


def lookup(table: str) -> str:
    return with_tables(
        f"""
SELECT ids.customer_id, {edge(table, 't', ('customer_id',))}, t.customer_id IS NOT NULL AS found
FROM ids LEFT JOIN {table} t ON t.customer_id = ids.customer_id""",
        ids=IDS,
    )


def search_customers() -> str:
    return with_tables(
        f"""
SELECT query_id, {edge('customers', 'h')} FROM hits h WHERE place <= 20""",
        queries=QUERIES,
        hits="""
  SELECT query_id, c.*, row_number() OVER (PARTITION BY query_id ORDER BY c.customer_id) AS place
  FROM queries JOIN customers c
    ON lower(first_name || ' ' || last_name) LIKE lower('%' || name_query || '%')""",
    )


def recent_activity(limit: int) -> str:
    return with_tables(
        f"""
SELECT event_id, customer_id, event_date, event_type, CAST(NULL AS VARCHAR) AS from_tier,
       CAST(NULL AS VARCHAR) AS to_tier, CAST(NULL AS VARCHAR) AS trigger_source, campaign_id
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_date DESC, event_id DESC)
                AS place
      FROM membership_history WHERE customer_id IN (SELECT customer_id FROM ids))
WHERE place <= {limit}""",
        ids=IDS,
    )


def customer_360() -> str:
    return with_tables(
        """
SELECT ids.customer_id, c.customer_id IS NOT NULL AS found, c.last_name, c.membership_type,
       r.customer_id IS NOT NULL AS has_renewal, r.renewal_date, r.renewal_likelihood,
       o.customer_id IS NOT NULL AS has_offer, t.customer_id IS NOT NULL AS has_health, t.ai_tier,
       t.churn_risk, CAST(t.churn_probability_pct AS DOUBLE) AS churn_probability_pct,
       a.activity
FROM ids LEFT JOIN customers c USING (customer_id) LEFT JOIN renewals r USING (customer_id)
LEFT JOIN upgrade_offers o USING (customer_id) LEFT JOIN customer_tiers t USING (customer_id)
LEFT JOIN latest a USING (customer_id)""",
        ids=IDS,
        latest="""
  SELECT customer_id, string_agg(event_id || ':' || event_type, ',' ORDER BY place) AS activity
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                                     ORDER BY event_date DESC, event_id DESC) AS place
        FROM membership_history)
  WHERE place <= 5 GROUP BY customer_id""",
    )
