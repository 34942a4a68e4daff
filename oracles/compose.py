"""Statements for the analyses composed of reports; they build on the report statements."""

from __future__ import annotations

from oracles import reports
from oracles.tables import fixed, with_tables


def _staff(city: str | None = None) -> str:
    return f"""
  SELECT city, CAST(sum(active_headcount) AS BIGINT) AS active_headcount,
         CAST(sum(therapist_headcount) AS BIGINT) AS therapist_headcount,
         CAST(sum(open_requisitions) AS BIGINT) AS open_requisitions
  FROM ({reports.staffing_summary(city)}) GROUP BY city"""


def _demand(months: int) -> str:
    return f"""
  SELECT city, sum(booking_count) AS bookings,
         CAST(sum(CAST(therapist_hours_required AS DECIMAL(18,2))) AS DOUBLE) AS hours
  FROM ({reports.booking_demand(months)}) GROUP BY city"""


def revenue_outliers(months: int = 12) -> str:
    return f"""
WITH trend AS ({reports.revenue_trend(months)}),
compared AS (
  SELECT *, lag(total_revenue) OVER (PARTITION BY city ORDER BY "month") AS previous_revenue,
         total_revenue / median(total_revenue) OVER (PARTITION BY "month") AS raw_ratio FROM trend),
rated AS (
  SELECT *, (total_revenue - previous_revenue) / nullif(previous_revenue, 0) * 100 AS change
  FROM compared)
SELECT city, "month", total_revenue, previous_revenue, {fixed('change', 2, 'change_pct')},
       {fixed('raw_ratio', 2, 'ratio_to_median')}, raw_ratio >= 5 AS is_outlier
FROM rated"""


def margin_trend(months: int = 6, losses_only: bool = False) -> str:
    return f"""
WITH pnl AS ({reports.location_pnl(months)}),
trend AS (
  SELECT *, margin_pct - lag(margin_pct) OVER (PARTITION BY city ORDER BY "month") AS change FROM pnl)
SELECT city, "month", revenue, labor_cost, profit, margin_pct, {fixed('change', 2, 'margin_change')},
       labor_cost > revenue AS labor_above_revenue
FROM trend {'WHERE labor_cost > revenue' if losses_only else ''}"""


def understaffing(months: int = 6) -> str:
    return f"""
WITH staff AS ({_staff()}), demand AS ({_demand(months)}),
loaded AS (
  SELECT *, coalesce(hours, 0) / {months} AS monthly,
         CASE WHEN therapist_headcount > 0 THEN coalesce(hours, 0) / {months} / therapist_headcount
           END AS per_head
  FROM staff LEFT JOIN demand USING (city))
SELECT city, CAST(coalesce(bookings, 0) AS BIGINT) AS booking_count,
       {fixed('monthly', 2, 'monthly_therapist_hours')}, therapist_headcount, open_requisitions,
       {fixed('per_head', 2, 'hours_per_therapist')},
       therapist_headcount = 0 AND monthly > 0 AS demand_without_staff
FROM loaded"""


def room_payback(cost: float, months: int = 6) -> str:
    return f"""
WITH rooms AS ({reports.revenue_per_room(months)}),
paid AS (
  SELECT *, CASE WHEN avg_monthly_revenue_per_room > 0
                 THEN CAST({cost} AS DOUBLE) / avg_monthly_revenue_per_room END AS payback FROM rooms)
SELECT city, avg_monthly_revenue, treatment_rooms, avg_monthly_revenue_per_room,
       {fixed('payback', 1, 'payback_months')}
FROM paid"""


def capacity_pressure() -> str:
    return with_tables(f"""
SELECT city, monthly_capacity, {fixed('peak', 1, 'peak_load_pct')},
       {fixed('highest', 1, 'peak_upper_load_pct')}, first_full_month
FROM (
  SELECT m.location_id, m.city, CAST(m.monthly_capacity AS BIGINT) AS monthly_capacity,
         max(f.predicted_bookings / nullif(m.monthly_capacity, 0)) * 100 AS peak,
         max(f.upper_bound / nullif(m.monthly_capacity, 0)) * 100 AS highest,
         min(f.forecast_month) FILTER (m.monthly_capacity > 0 AND f.predicted_bookings >= m.monthly_capacity)
           AS first_full_month
  FROM location_master m JOIN forecast_bookings f ON json_extract_string(f.city, '$') = m.city
  GROUP BY ALL)""")


def churn_against_visits() -> str:
    members = with_tables(
        "SELECT corr(churn_probability_pct, days_since_last_visit) AS link FROM customer_tiers"
    )
    return f"""
SELECT cohorts.*, round(link * 10000) / 10000 AS churn_visit_correlation
FROM ({reports.churn_cohorts('churnRisk')}) AS cohorts CROSS JOIN ({members}) AS linked"""


def overtime_saving(cut_pct: float, months: int = 6) -> str:
    return f"""
WITH labor AS ({reports.labor_cost_by_role(months)}),
city_labor AS (
  SELECT city, CAST(sum(CAST(overtime_cost AS DECIMAL(18,2))) AS DOUBLE) AS overtime_cost FROM labor
  GROUP BY city),
cut AS (SELECT *, overtime_cost * (CAST({cut_pct} AS DOUBLE) / 100) AS raw FROM city_labor)
SELECT city, overtime_cost, {fixed('raw', 2, 'saving')} FROM cut"""


def staffing_against_churn() -> str:
    return f"""
WITH churn AS ({reports.churn_by_location()}), staff AS ({_staff()}),
both_sides AS (
  SELECT *, CASE WHEN therapist_headcount > 0
                 THEN CAST(customer_count AS DOUBLE) / therapist_headcount END AS per_head
  FROM churn JOIN staff USING (city))
SELECT city, customer_count, avg_churn_probability_pct, high_churn_risk_pct, active_headcount,
       therapist_headcount, {fixed('per_head', 1, 'customers_per_therapist')}
FROM both_sides"""


def cost_gap(city: str, other: str, months: int = 6) -> str:
    return f"""
WITH costs AS (
  SELECT city, 'labor' AS cost_type, role AS item, total_labor_cost AS amount
  FROM ({reports.labor_cost_by_role(months)})
  UNION ALL
  SELECT city, 'operations', cost_category, amount
  FROM ({reports.operational_costs_by_category(months)})),
sides AS (
  SELECT cost_type, item, sum(CASE WHEN city = '{city}' THEN amount ELSE 0 END) AS amount,
         sum(CASE WHEN city = '{other}' THEN amount ELSE 0 END) AS other_amount
  FROM costs WHERE city IN ('{city}', '{other}') GROUP BY cost_type, item),
gaps AS (SELECT *, amount - other_amount AS gap FROM sides)
SELECT cost_type, item, amount, other_amount, {fixed('gap', 2, 'difference')} FROM gaps"""


def quarterly_demand(months: int = 24) -> str:
    return f"""
WITH quarters AS (
  SELECT city, CAST(date_trunc('quarter', "month") AS DATE) AS "quarter",
         CAST(sum(booking_count) AS BIGINT) AS booking_count,
         CAST(sum(CAST(therapist_hours_required AS DECIMAL(18,2))) AS DOUBLE)
           AS therapist_hours_required,
         count(*) AS months_covered
  FROM ({reports.booking_demand(months)}) GROUP BY ALL),
compared AS (
  SELECT *, lag(booking_count) OVER (PARTITION BY city ORDER BY "quarter") AS earlier FROM quarters),
growth AS (
  SELECT *, CASE WHEN earlier > 0 THEN CAST(booking_count - earlier AS DOUBLE) / earlier END * 100
    AS raw FROM compared)
SELECT city, "quarter", booking_count, therapist_hours_required, months_covered,
       {fixed('raw', 1, 'growth_pct')}
FROM growth"""


def hiring_plan(months: int = 6) -> str:
    return f"""
WITH staff AS ({_staff()}), demand AS ({_demand(months)}),
cities AS (
  SELECT *, coalesce(hours, 0) / {months} AS monthly FROM staff LEFT JOIN demand USING (city)),
others AS (
  SELECT CAST(sum(active_headcount) AS DOUBLE) / count(*) AS heads,
         CAST(sum(therapist_headcount) AS DOUBLE) / count(*) AS therapists,
         sum(hours) / {months} / CAST(sum(therapist_headcount) AS DOUBLE) AS load
  FROM cities WHERE therapist_headcount > 0),
planned AS (SELECT * FROM cities CROSS JOIN others WHERE active_headcount = 0)
SELECT city, {fixed('monthly', 2, 'monthly_therapist_hours')}, open_requisitions,
       {fixed('heads', 1, 'comparable_headcount')},
       {fixed('load', 2, 'comparable_hours_per_therapist')},
       CAST(ceil(CASE WHEN monthly > 0 AND load > 0 THEN monthly / load ELSE therapists END) AS BIGINT)
         AS suggested_therapists
FROM planned"""
