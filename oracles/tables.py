"""The derived tables as DuckDB common table expressions.

Written from the table definitions, not from the Spark code: facts are inner-typed SQL over the
driver's views, and ``with_tables`` puts the needed ones in front of a report statement.
"""

from __future__ import annotations

import re

_MONEY = "DECIMAL(18,2)"
_ROLE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Lead Therapist' WHEN '2-HIGH' THEN 'Therapist'
    WHEN '3-MEDIUM' THEN 'Front Desk' WHEN '4-NOT SPECIFIED' THEN 'Manager'
    WHEN '5-LOW' THEN 'Attendant' END"""


def month(column: str) -> str:
    return f"CAST(date_trunc('month', {column}) AS DATE)"


TABLES: dict[str, str] = {
    "location_master": """
  SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS city,
         count(s_suppkey) AS treatment_rooms, 8 * count(s_suppkey) AS monthly_capacity
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
  UNION ALL
  SELECT 1000 + CAST(r_regionkey AS BIGINT), r_name, 0, 0 FROM region""",
    "bookings": f"""
  SELECT CAST(s_nationkey AS BIGINT) AS location_id, {month('l_shipdate')} AS booking_month,
         p_type AS service_type, count(*) AS booking_count,
         sum(CAST(l_extendedprice AS {_MONEY})) AS revenue,
         count(*) FILTER (WHERE l_returnflag = 'R') AS refund_count,
         sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS {_MONEY}) ELSE 0 END)
           AS refund_amount,
         sum(CAST(l_quantity AS {_MONEY})) AS therapist_hours_required
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY ALL""",
    "labor_costs": f"""
  SELECT CAST(c_nationkey AS BIGINT) AS location_id, {month('o_orderdate')} AS "month",
         {_ROLE} AS role, count(DISTINCT o_custkey) AS headcount,
         sum(CAST(o_totalprice AS {_MONEY})) * CAST(0.4 AS DECIMAL(2,1)) AS total_labor_cost,
         sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS {_MONEY}) ELSE 0 END)
           * CAST(0.1 AS DECIMAL(2,1)) AS overtime_cost
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
    "operational_costs": f"""
  SELECT CAST(s_nationkey AS BIGINT) AS location_id, {month('l_shipdate')} AS "month",
         p_brand AS cost_category,
         sum(CAST(l_extendedprice AS {_MONEY}) * CAST(l_discount AS DECIMAL(4,2))) AS amount
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY ALL""",
    "recruiting_costs": f"""
  SELECT CAST(c_nationkey AS BIGINT) AS location_id, {month('o_orderdate')} AS "month",
         sum(CAST(o_totalprice AS {_MONEY})) * CAST(0.02 AS DECIMAL(3,2)) AS amount
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
    "customers": f"""
  SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name, CAST(c_nationkey AS BIGINT) AS home_location_id,
         CAST(min(o_orderdate) AS DATE) AS join_date,
         CAST(max(o_orderdate) AS DATE) AS last_visit_date,
         nullif(count(o_orderkey), 0) AS total_visits,
         sum(CAST(o_totalprice AS {_MONEY})) AS lifetime_spend,
         CAST(sum(CAST(o_totalprice AS {_MONEY})) AS DOUBLE) / nullif(count(o_orderkey), 0)
           AS avg_spend_per_visit,
         c_mktsegment AS membership_type,
         CAST(greatest(floor(c_acctbal / 1000) + 1, 0) AS BIGINT) AS nps_score,
         date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01')
           AS days_since_last_visit,
         nullif(count(o_orderkey), 0) / 80.0::DOUBLE AS visit_frequency_monthly,
         c_acctbal >= 0 AS is_active
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  GROUP BY c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal""",
    "scored": """
  SELECT *, CAST(least(99, floor(days_since_last_visit / 8)) AS BIGINT) AS churn_probability_pct
  FROM customers WHERE total_visits IS NOT NULL""",
    "customer_tiers": """
  SELECT customer_id, first_name, last_name, home_location_id, lifetime_spend, total_visits,
         visit_frequency_monthly, days_since_last_visit, nps_score, membership_type,
         CASE WHEN lifetime_spend >= 4000000 THEN 'Platinum' WHEN lifetime_spend >= 2500000 THEN 'Gold'
              WHEN lifetime_spend >= 1500000 THEN 'Silver' ELSE 'Bronze' END AS ai_tier,
         CASE WHEN churn_probability_pct >= 60 THEN 'High' WHEN churn_probability_pct >= 30
              THEN 'Medium' ELSE 'Low' END AS churn_risk,
         churn_probability_pct,
         CAST(lifetime_spend * CAST(0.15 AS DECIMAL(3,2)) AS DOUBLE) AS predicted_ltv_12m,
         lifetime_spend * CAST(0.15 AS DECIMAL(3,2)) AS exact_ltv
  FROM scored""",
    "renewals": """
  SELECT customer_id AS renewal_id, customer_id, membership_type AS current_tier, home_location_id,
         CAST(last_visit_date + INTERVAL 365 DAY AS DATE) AS renewal_date, total_visits,
         visit_frequency_monthly, days_since_last_visit, nps_score, lifetime_spend,
         100 - churn_probability_pct AS renewal_probability_pct,
         CASE WHEN churn_probability_pct > 75 THEN 'Unlikely' WHEN churn_probability_pct > 50
              THEN 'At Risk' WHEN churn_probability_pct > 25 THEN 'Moderate' ELSE 'Very Likely' END
           AS renewal_likelihood,
         nps_score >= 9 AS upgrade_candidate
  FROM scored WHERE is_active""",
    "upgrade_offers": """
  SELECT customer_id, first_name, last_name, membership_type AS current_tier,
         visit_frequency_monthly, lifetime_spend,
         CAST(last_visit_date + INTERVAL 365 DAY AS DATE) AS renewal_date
  FROM scored WHERE is_active AND nps_score >= 9 AND churn_probability_pct < 50""",
    "membership_history": """
  SELECT event_id, user_id AS customer_id, CAST(ts AS DATE) AS event_date,
         CASE event_type WHEN 'signup' THEN 'Signup' WHEN 'purchase' THEN 'Upgrade' WHEN 'error'
              THEN 'Downgrade' WHEN 'click' THEN 'Renewal' WHEN 'view' THEN 'Cancellation' END
           AS event_type,
         CASE WHEN event_type IN ('click', 'purchase')
              THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS campaign_id
  FROM events""",
    "campaigns": f"""
  SELECT p_partkey AS campaign_id, p_name AS campaign_name, p_type AS channel,
         CAST(p_retailprice AS {_MONEY}) AS budget,
         CASE WHEN p_type = 'PROMO' THEN 0 ELSE CAST(p_size AS BIGINT) END AS total_converted,
         CAST(p_retailprice AS {_MONEY}) * p_size AS revenue_attributed
  FROM part""",
    "campaign_responses": """
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS campaign_id, user_id AS customer_id
  FROM events WHERE event_type IN ('click', 'purchase')""",
    "employees": f"""
  SELECT CAST(c_nationkey AS BIGINT) AS location_id, {_ROLE} AS role,
         CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Terminated' WHEN 'P' THEN 'Leave'
           END AS employment_status,
         CAST(o_orderdate AS DATE) AS hire_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE)
              + CAST(floor(o_totalprice / 1000) AS INTEGER) END AS termination_date,
         CAST(o_totalprice AS {_MONEY}) AS compensation_annual
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "requisitions": f"""
  SELECT CAST(c_nationkey AS BIGINT) AS location_id, {_ROLE} AS role,
         CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Cancelled'
           END AS status,
         CAST(floor(o_totalprice / 100000) + 1 AS BIGINT) AS headcount_requested,
         CAST(o_orderdate AS DATE) AS posted_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE)
              + CAST(floor(o_totalprice / 10000) AS INTEGER) END AS filled_date
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "monthly_bookings": """
  SELECT location_id, booking_month, CAST(sum(booking_count) AS DOUBLE) AS n
  FROM bookings
  WHERE booking_month > (SELECT max(booking_month) FROM bookings) - INTERVAL 12 MONTH GROUP BY ALL""",
    "forecast_bookings": """
  SELECT '"' || city || '"' AS city,
         CAST((SELECT max(booking_month) FROM bookings) + to_months(CAST(ahead AS INTEGER)) AS DATE)
           AS forecast_month,
         predicted AS predicted_bookings, greatest(predicted - spread * 1.96::DOUBLE, 0) AS lower_bound,
         predicted + spread * 1.96::DOUBLE AS upper_bound
  FROM (SELECT location_id, sum(n) / count(*) AS predicted,
               CASE WHEN count(*) > 1 THEN sqrt((sum(n * n) - sum(n) * sum(n) / count(*))
                    / (count(*) - 1)) ELSE 0 END AS spread
        FROM monthly_bookings GROUP BY location_id)
  JOIN location_master USING (location_id) CROSS JOIN (VALUES (1), (2), (3)) AS h(ahead)""",
    "forecast_attrition": f"""
  SELECT '"' || city || '"' AS city,
         CAST(latest + to_months(CAST(ahead AS INTEGER)) AS DATE) AS forecast_month,
         avg(n) AS predicted_terminations, max(n) AS worst_case_terminations
  FROM (SELECT location_id, {month('termination_date')} AS m, CAST(count(*) AS DOUBLE) AS n
        FROM employees WHERE termination_date IS NOT NULL GROUP BY ALL)
  CROSS JOIN (SELECT {month('max(termination_date)')} AS latest FROM employees)
  JOIN location_master USING (location_id) CROSS JOIN (VALUES (1), (2), (3)) AS h(ahead)
  WHERE m > latest - INTERVAL 12 MONTH GROUP BY city, latest, ahead""",
}


def with_tables(statement: str, recursive: bool = False, **steps: str) -> str:
    """``statement`` behind the derived tables it mentions, directly or through others.

    ``steps`` are further named expressions, placed after the tables in the order given.
    """
    body = " ".join([statement, *steps.values()])
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{name} AS ({TABLES[name]}\n)" for name in needed]
    parts += [f"{name} AS ({text}\n)" for name, text in steps.items()]
    if not parts:
        return statement
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} " + ",\n".join(parts) + "\n" + statement


def fixed(column: str, digits: int, alias: str | None = None) -> str:
    """Fixed-digit rounding of a double column: exact ties away from zero, all else as printed.

    ``printf`` rounds the exact binary value; it only differs on exact ties, which for one decimal
    are odd quarters and for two decimals odd eighths.
    """
    ties, scale = {1: (4, 10), 2: (8, 100)}[digits]
    return (
        f"CASE WHEN {column} IS NULL THEN NULL "
        f"WHEN {column} * {ties} = floor({column} * {ties}) THEN round({column} * {scale}) / {scale} "
        f"ELSE CAST(printf('%.{digits}f', CAST({column} AS DOUBLE)) AS DOUBLE) END + 0.0::DOUBLE"
        f" AS {alias or column}"
    )


def double(expression: str, alias: str) -> str:
    return f"coalesce(CAST({expression} AS DOUBLE), 0.0::DOUBLE) AS {alias}"


def since(table: str, column: str, months: int) -> str:
    """Strict look-back condition on a month column, anchored on the whole table."""
    return f"{column} > (SELECT max({column}) FROM {table}) - INTERVAL {months} MONTH"
