"""Additive monthly totals of the large fact tables, kept month by month and shared by reports.

Most reports on bookings and operating costs add up the same measures over locations, months and one
attribute. Summed once to that grain, a table is as small as its locations, months and attributes, and as
it has the columns of the table it stands for, every report runs on it unchanged.
"""

from __future__ import annotations

import threading
import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.schemas import MONTH_COLUMNS, TABLES
from memberlens.session import ensure_checkpoint_dir
from memberlens.sources.warehouse import Lookback, ParquetWarehouse, Warehouse

#: tables of which all measures are sums: what they are grouped by beside location and month
ADDITIVE = {"bookings": "service_type", "operational_costs": "cost_category"}


def monthly_totals(wh: Warehouse, name: str, since: date | None = None) -> DataFrame:
    """``name`` summed by location, month and attribute, with the columns of ``name``; from month ``since`` on."""
    fields = TABLES[name]
    month, keys = MONTH_COLUMNS[name], ["location_id", MONTH_COLUMNS[name], ADDITIVE[name]]
    rows = wh.table(name)
    if since is not None:
        rows = rows.where(F.col(month) >= F.lit(since))
    totals = {f.name: F.sum(f.name) for f in fields if f.name not in keys}
    return rows.groupBy(*keys).agg(*(total.alias(n) for n, total in totals.items())).select(*fields.fieldNames())


def write_monthly_totals(wh: Warehouse, root: str, name: str, since: date | None = None) -> None:
    """Keep the totals of ``name`` below ``root``, one folder for each month; ``since`` renews later months only."""
    totals, month = monthly_totals(wh, name, since), MONTH_COLUMNS[name]
    totals.hint("rebalance", F.col(month)).write.mode("overwrite").option(
        "partitionOverwriteMode", "static" if since is None else "dynamic"
    ).partitionBy(month).parquet(f"{root}/{name}")


class RolledUpWarehouse(Warehouse):
    """``base`` with its additive tables replaced by their monthly totals, each summed when it is first asked for.

    With a ``root`` the totals are kept there (and taken from there if another job wrote them); without one they
    are staged for this object. Safe to share between the threads of ``run_many``.
    """

    def __init__(self, base: Warehouse, root: str | None = None):
        super().__init__(base.spark)
        self.base = base
        self.root = root or f"{ensure_checkpoint_dir(base.spark).rstrip('/')}/totals-{uuid.uuid4().hex}"
        self._totals = ParquetWarehouse(base.spark, self.root)
        self._kept = root is not None
        self._written: set[str] = set()
        self._lock = threading.Lock()

    def _source(self, name: str) -> Warehouse:
        if name not in ADDITIVE:
            return self.base
        with self._lock:
            if name not in self._written:
                if not (self._kept and self._exists(name)):
                    write_monthly_totals(self.base, self.root, name)
                self._written.add(name)
        return self._totals

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return self._source(name).table(name, columns)

    def lookback(self, name: str, months: int) -> Lookback:
        return self._source(name).lookback(name, months)

    def rows(self, name: str, columns: list[str], window: Lookback) -> DataFrame:
        return self._source(name).rows(name, columns, window)
