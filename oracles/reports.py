"""Statements for the aggregate reports."""

from __future__ import annotations

from oracles.tables import double, fixed, since, with_tables

_CITY_JOIN = "JOIN location_master USING (location_id)"


def _city(city: str | None) -> str:
    return f"AND city = '{city}'" if city else ""


def revenue_trend(months: int = 12, city: str | None = None) -> str:
    return with_tables(f"""
SELECT city, booking_month AS "month", {double('sum(revenue)', 'total_revenue')}
FROM bookings {_CITY_JOIN} WHERE {since('bookings', 'booking_month', months)} {_city(city)}
GROUP BY city, booking_month""")


def location_pnl(months: int = 6, city: str | None = None) -> str:
    return with_tables(
        f"""
SELECT city, "month", revenue, labor_cost, operational_cost, total_cost, profit,
       {fixed('margin', 2, 'margin_pct')}
FROM (SELECT *, CASE WHEN revenue > 0 THEN profit / revenue * 100 ELSE 0 END AS margin
      FROM (SELECT *, revenue - total_cost AS profit
            FROM (SELECT *, labor_cost + operational_cost AS total_cost FROM costed)))""",
        rev=f"""
  SELECT location_id, booking_month AS "month", sum(revenue) AS revenue FROM bookings
  WHERE {since('bookings', 'booking_month', months)} GROUP BY ALL""",
        labor="""
  SELECT location_id, "month", sum(total_labor_cost) AS labor_cost FROM labor_costs GROUP BY ALL""",
        opex="""
  SELECT location_id, "month", sum(amount) AS operational_cost FROM operational_costs GROUP BY ALL""",
        costed=f"""
  SELECT city, rev."month", CAST(revenue AS DOUBLE) AS revenue, {double('labor_cost', 'labor_cost')},
         {double('operational_cost', 'operational_cost')}
  FROM rev JOIN location_master USING (location_id)
  LEFT JOIN labor ON labor.location_id = rev.location_id AND labor."month" = rev."month"
  LEFT JOIN opex ON opex.location_id = rev.location_id AND opex."month" = rev."month"
  WHERE true {_city(city)}""",
    )


def refund_breakdown(months: int = 12, city: str | None = None) -> str:
    service = "service_type" if city else "CAST(NULL AS VARCHAR) AS service_type"
    return with_tables(f"""
SELECT city, service_type, booking_count, refund_count, refund_amount, revenue,
       {fixed('rate', 2, 'refund_rate_pct')}
FROM (SELECT *, CASE WHEN booking_count > 0 THEN CAST(refund_count AS DOUBLE) / booking_count * 100
                     ELSE 0 END AS rate
      FROM (SELECT city, {service}, CAST(sum(booking_count) AS BIGINT) AS booking_count,
                   CAST(sum(refund_count) AS BIGINT) AS refund_count,
                   {double('sum(refund_amount)', 'refund_amount')}, {double('sum(revenue)', 'revenue')}
            FROM bookings {_CITY_JOIN}
            WHERE {since('bookings', 'booking_month', months)} {_city(city)} GROUP BY ALL))""")


def revenue_per_room(months: int = 6, city: str | None = None) -> str:
    return with_tables(f"""
SELECT city, {fixed('monthly', 2, 'avg_monthly_revenue')}, treatment_rooms,
       {fixed('per_room', 2, 'avg_monthly_revenue_per_room')}
FROM (SELECT *, CASE WHEN treatment_rooms > 0 THEN monthly / treatment_rooms ELSE 0 END AS per_room
      FROM (SELECT city, CAST(treatment_rooms AS BIGINT) AS treatment_rooms,
                   CAST(sum(revenue) AS DOUBLE) / {months} AS monthly
            FROM bookings {_CITY_JOIN}
            WHERE {since('bookings', 'booking_month', months)} {_city(city)} GROUP BY ALL))""")


def labor_cost_by_role(months: int = 6, city: str | None = None) -> str:
    return with_tables(f"""
SELECT city, role, {fixed('heads', 1, 'headcount')}, total_labor_cost, overtime_cost,
       {fixed('per_head', 2, 'cost_per_employee')}
FROM (SELECT *, CASE WHEN heads > 0 THEN total_labor_cost / heads ELSE 0 END AS per_head
      FROM (SELECT city, role, CAST(sum(headcount) AS DOUBLE) / count(*) AS heads,
                   {double('sum(total_labor_cost)', 'total_labor_cost')},
                   {double('sum(overtime_cost)', 'overtime_cost')}
            FROM labor_costs {_CITY_JOIN}
            WHERE {since('labor_costs', '"month"', months)} {_city(city)} GROUP BY ALL))""")


def revenue_by_service(months: int = 6, city: str | None = None) -> str:
    return with_tables(f"""
SELECT city, service_type, CAST(sum(booking_count) AS BIGINT) AS booking_count,
       {double('sum(revenue)', 'revenue')}
FROM bookings {_CITY_JOIN} WHERE {since('bookings', 'booking_month', months)} {_city(city)}
GROUP BY ALL""")


def operational_costs_by_category(months: int = 6, city: str | None = None) -> str:
    return with_tables(f"""
SELECT city, cost_category, {double('sum(amount)', 'amount')}
FROM operational_costs {_CITY_JOIN}
WHERE {since('operational_costs', '"month"', months)} {_city(city)} GROUP BY ALL""")


def booking_demand(months: int = 6, city: str | None = None) -> str:
    return with_tables(f"""
SELECT city, booking_month AS "month", CAST(sum(booking_count) AS BIGINT) AS booking_count,
       {double('sum(therapist_hours_required)', 'therapist_hours_required')}
FROM bookings {_CITY_JOIN} WHERE {since('bookings', 'booking_month', months)} {_city(city)}
GROUP BY ALL""")


def booking_forecast(city: str | None = None) -> str:
    return with_tables(f"""
SELECT m.city, forecast_month, predicted_bookings, lower_bound, upper_bound,
       CAST(monthly_capacity AS BIGINT) AS monthly_capacity
FROM forecast_bookings f JOIN location_master m ON m.city = json_extract_string(f.city, '$')
WHERE true {f"AND m.city = '{city}'" if city else ''}""")


def retention_risk(city: str | None = None) -> str:
    return with_tables(f"""
SELECT json_extract_string(city, '$') AS city, forecast_month, predicted_terminations,
       worst_case_terminations
FROM forecast_attrition
WHERE true {f"AND json_extract_string(city, '$') = '{city}'" if city else ''}""")


def staffing_summary(city: str | None = None) -> str:
    return with_tables(
        f"""
SELECT city, CAST(coalesce(active, 0) AS BIGINT) AS active_headcount,
       CAST(coalesce(therapists, 0) AS BIGINT) AS therapist_headcount,
       CAST(coalesce(open_reqs, 0) AS BIGINT) AS open_requisitions,
       CAST(coalesce(requested, 0) AS BIGINT) AS headcount_requested,
       {double('spend', 'recruiting_spend_last_6_months')}
FROM location_master lm LEFT JOIN emp USING (location_id) LEFT JOIN reqs USING (location_id)
LEFT JOIN hiring USING (location_id) WHERE true {_city(city)}""",
        emp="""
  SELECT location_id, count(*) AS active,
         count(*) FILTER (WHERE role ILIKE '%therapist%') AS therapists
  FROM employees WHERE employment_status = 'Active' GROUP BY ALL""",
        reqs="""
  SELECT location_id, count(*) FILTER (WHERE status = 'Open') AS open_reqs,
         sum(CASE WHEN status = 'Open' THEN headcount_requested ELSE 0 END) AS requested
  FROM requisitions GROUP BY ALL""",
        hiring=f"""
  SELECT location_id, sum(amount) AS spend FROM recruiting_costs
  WHERE {since('recruiting_costs', '"month"', 6)} GROUP BY ALL""",
    )


def tenure_and_turnover(city: str | None = None, role: str | None = None) -> str:
    return with_tables(f"""
SELECT city, role, headcount, {fixed('tenure', 1, 'avg_tenure_months')}, terminated_count,
       {fixed('turnover', 1, 'turnover_rate_pct')}, {fixed('pay', 2, 'avg_compensation_annual')}
FROM (SELECT city, role, count(*) FILTER (WHERE employment_status = 'Active') AS headcount,
             coalesce(CAST(sum(months) AS DOUBLE) / nullif(count(months), 0), 0) AS tenure,
             count(*) FILTER (WHERE employment_status = 'Terminated') AS terminated_count,
             CAST(count(*) FILTER (WHERE employment_status = 'Terminated') AS DOUBLE)
               / count(*) * 100 AS turnover,
             CAST(sum(compensation_annual) AS DOUBLE) / count(*) AS pay
      FROM (SELECT *, CASE WHEN employment_status = 'Active'
                           THEN date_diff('month', hire_date, DATE '2001-12-01')
                           ELSE date_diff('month', hire_date, termination_date) END AS months
            FROM employees)
      {_CITY_JOIN} WHERE true {_city(city)} {f"AND role = '{role}'" if role else ''} GROUP BY ALL)""")


def recruiting_pipeline(city: str | None = None, role: str | None = None) -> str:
    return with_tables(f"""
SELECT city, role, open_count, filled_count, {fixed('to_fill', 1, 'avg_days_to_fill')},
       {fixed('waiting', 1, 'avg_days_open_for_still_open')}
FROM (SELECT city, role, count(*) FILTER (WHERE status = 'Open') AS open_count,
             count(*) FILTER (WHERE status = 'Filled') AS filled_count,
             avg(CASE WHEN status = 'Filled' THEN date_diff('day', posted_date, filled_date) END)
               AS to_fill,
             avg(CASE WHEN status = 'Open' THEN date_diff('day', posted_date, DATE '2001-12-01') END)
               AS waiting
      FROM requisitions {_CITY_JOIN}
      WHERE true {_city(city)} {f"AND role = '{role}'" if role else ''} GROUP BY ALL)""")


def churn_cohorts(group_by: str) -> str:
    key = {"tier": "membership_type", "churnRisk": "churn_risk"}[group_by]
    return with_tables(f"""
SELECT group_value, customer_count, {fixed('ltv', 2, 'avg_ltv')},
       {fixed('churn', 1, 'avg_churn_probability_pct')},
       {fixed('visits', 2, 'avg_visit_frequency_monthly')},
       {fixed('days', 1, 'avg_days_since_last_visit')}, {fixed('nps', 1, 'avg_nps_score')}
FROM (SELECT {key} AS group_value, count(*) AS customer_count,
             CAST(sum(exact_ltv) AS DOUBLE) / count(*) AS ltv,
             avg(churn_probability_pct) AS churn,
             CAST(sum(CAST(total_visits AS DECIMAL(18,0)) * CAST(0.0125 AS DECIMAL(4,4))) AS DOUBLE)
               / count(*) AS visits,
             avg(days_since_last_visit) AS days, avg(nps_score) AS nps
      FROM customer_tiers GROUP BY ALL)""")


def churn_by_location() -> str:
    return with_tables(f"""
SELECT city, customer_count, {fixed('churn', 1, 'avg_churn_probability_pct')}, high_churn_risk_count,
       {fixed('high', 1, 'high_churn_risk_pct')}
FROM (SELECT city, count(*) AS customer_count, avg(churn_probability_pct) AS churn,
             count(*) FILTER (WHERE churn_risk = 'High') AS high_churn_risk_count,
             CAST(count(*) FILTER (WHERE churn_risk = 'High') AS DOUBLE) / count(*) * 100 AS high
      FROM customer_tiers JOIN location_master ON location_id = home_location_id GROUP BY city)""")


def campaign_performance(channel: str | None = None) -> str:
    return with_tables(f"""
SELECT channel, total_budget, total_converted, total_revenue_attributed,
       {fixed('cost', 2, 'cost_per_acquisition')}
FROM (SELECT *, CASE WHEN total_converted > 0 THEN total_budget / total_converted END AS cost
      FROM (SELECT channel, {double('sum(budget)', 'total_budget')},
                   CAST(sum(total_converted) AS BIGINT) AS total_converted,
                   {double('sum(revenue_attributed)', 'total_revenue_attributed')}
            FROM campaigns {f"WHERE channel = '{channel}'" if channel else ''} GROUP BY channel))""")


def campaign_retention() -> str:
    return with_tables(
        f"""
SELECT campaign_name, responded_customer_count, at_risk_or_unlikely_renewal_count,
       {fixed('risk', 1, 'at_risk_or_unlikely_renewal_pct')},
       {fixed('churn', 1, 'avg_churn_probability_pct')}
FROM (SELECT campaign_name, count(*) AS responded_customer_count,
             count(*) FILTER (WHERE renewal_likelihood IN ('At Risk', 'Unlikely'))
               AS at_risk_or_unlikely_renewal_count,
             CAST(count(*) FILTER (WHERE renewal_likelihood IN ('At Risk', 'Unlikely')) AS DOUBLE)
               / count(*) * 100 AS risk,
             coalesce(avg(churn_probability_pct), 0) AS churn
      FROM responders JOIN campaigns USING (campaign_id)
      LEFT JOIN renewals USING (customer_id)
      LEFT JOIN customer_tiers USING (customer_id)
      GROUP BY campaign_name)""",
        responders="""
  SELECT DISTINCT campaign_id, customer_id FROM campaign_responses""",
    )


def enumerated_values() -> str:
    closed = {
        ("renewals", "renewal_likelihood"): ["At Risk", "Moderate", "Unlikely", "Very Likely"],
        ("membership_history", "event_type"): [
            "Signup", "Upgrade", "Downgrade", "Renewal", "Cancellation",
        ],
        ("customer_tiers", "ai_tier"): ["Bronze", "Silver", "Gold", "Platinum"],
        ("customer_tiers", "churn_risk"): ["High", "Medium", "Low"],
    }
    parts = [
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value,
       count(*) AS row_count, coalesce({column} IN ({", ".join(f"'{v}'" for v in values)}), false)
         AS is_allowed
FROM {table} GROUP BY {column}"""
        for (table, column), values in closed.items()
    ]
    return with_tables("\nUNION ALL\n".join(parts))
