"""All reports by name, for callers that pick them at run time.

Each request stands alone: an unknown name, a refused argument or a failing job is reported for that
request and leaves the others untouched.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from memberlens.params import InvalidParameter
from memberlens.plans import adhoc, compose, customers, finance, health, locations, marketing, workforce
from memberlens.sources.rollup import RolledUpWarehouse
from memberlens.sources.warehouse import Warehouse


def readonly_sql(wh: Warehouse, sql: str, args: dict | None = None) -> DataFrame:
    """A single query over the warehouse's tables, each a view of its name."""
    if not sql:
        raise InvalidParameter("sql must be a query")
    wh.register()
    return adhoc.run_readonly_sql(wh.spark, sql, args)


REPORTS: dict[str, Callable[..., DataFrame]] = {
    function.__name__: function
    for function in (
        customers.search_customers,
        customers.customer_profiles,
        customers.customer_renewals,
        customers.upgrade_offers,
        customers.recent_activity,
        customers.customer_health,
        health.churn_cohorts,
        health.churn_by_location,
        locations.revenue_trend,
        locations.booking_forecast,
        finance.location_pnl,
        finance.refund_breakdown,
        finance.revenue_per_room,
        finance.labor_cost_by_role,
        finance.revenue_by_service,
        finance.operational_costs_by_category,
        workforce.booking_demand,
        workforce.staffing_summary,
        workforce.tenure_and_turnover,
        workforce.retention_risk,
        workforce.recruiting_pipeline,
        marketing.campaign_performance,
        marketing.campaign_retention,
        compose.customer_360,
        compose.revenue_outliers,
        compose.margin_trend,
        compose.loss_months,
        compose.understaffing,
        compose.room_payback,
        compose.capacity_pressure,
        compose.churn_against_visits,
        compose.overtime_saving,
        compose.staffing_against_churn,
        compose.cost_gap,
        compose.quarterly_demand,
        compose.hiring_plan,
        readonly_sql,
    )
}


#: reports that read bookings or operating costs by sums only
ON_TOTALS = frozenset(
    function.__name__
    for function in (
        locations.revenue_trend, finance.location_pnl, finance.refund_breakdown, finance.revenue_per_room,
        finance.revenue_by_service, finance.operational_costs_by_category, workforce.booking_demand,
    )
)


@dataclass(frozen=True)
class Request:
    report: str
    arguments: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Outcome:
    request: Request
    result: Any = None
    error: str | None = None


def run_report(wh: Warehouse, name: str, **arguments) -> DataFrame:
    """The report's frame; nothing runs until it is used."""
    if name not in REPORTS:
        raise InvalidParameter(f"unknown report {name!r}")
    function = REPORTS[name]
    try:
        inspect.signature(function).bind(wh, **arguments)
    except TypeError as error:
        raise InvalidParameter(f"{name}: {error}") from error
    return function(wh, **arguments)


def run_many(
    wh: Warehouse,
    requests: Iterable[Request],
    action: Callable[[Request, DataFrame], Any] | None = None,
    workers: int = 4,
    share: bool = True,
) -> list[Outcome]:
    """Outcomes in the order of ``requests``.

    If several of them add up the same large table, it is summed by month once and all read the totals
    (``share``); results are the same.

    ``action`` is called with each request and its frame, for instance to write it; independent jobs
    then share the cluster, ``workers`` at a time. Without it the frames themselves are returned.
    """

    requests = list(requests)
    on_totals = [request for request in requests if request.report in ON_TOTALS]
    totals = RolledUpWarehouse(wh) if share and len(on_totals) > 1 else wh

    def run(request: Request) -> Outcome:
        try:
            frame = run_report(totals if request.report in ON_TOTALS else wh, request.report, **request.arguments)
            return Outcome(request, action(request, frame) if action else frame)
        except Exception as error:  # one request must not take down the others
            return Outcome(request, error=f"{type(error).__name__}: {error}")

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(run, requests))
