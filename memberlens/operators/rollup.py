"""Totals per location, then per city.

Facts are added up per ``location_id`` before they meet the location table. The partial aggregation
on the map side folds a hot location or month to one row per task, so only totals are shuffled and
the join works on rows counted in locations, whatever join Spark picks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_sites(facts: DataFrame, sites: DataFrame, city: str | tuple[str, ...] | None) -> DataFrame:
    """Drop other cities' facts before they are aggregated; a no-op without a city."""
    if not city:
        return facts
    return facts.join(sites.select("location_id"), "location_id", "left_semi")


def totals_by_site(
    facts: DataFrame, sites: DataFrame, city: str | tuple[str, ...] | None, keys: list[str | Column], **totals: Column
) -> DataFrame:
    """One row per location and ``keys`` with the aggregates in ``totals``."""
    aggregates = [column.alias(name) for name, column in totals.items()]
    return only_sites(facts, sites, city).groupBy("location_id", *keys).agg(*aggregates)


def totals_by_city(
    facts: DataFrame,
    sites: DataFrame,
    city: str | tuple[str, ...] | None,
    keys: list[str],
    site_columns: tuple[str, ...] = (),
    **totals: Column,
) -> DataFrame:
    """One row per city, ``site_columns`` and ``keys``; ``totals`` must be sums or counts."""
    per_site = totals_by_site(facts, sites, city, keys, **totals)
    again = [F.sum(name).alias(name) for name in totals]
    return (
        per_site.join(sites, "location_id").groupBy("city", *site_columns, *keys).agg(*again)
    )
