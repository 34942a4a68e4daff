"""Access to the sixteen tables: a folder of parquet tables, or frames already at hand."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.schemas import MONTH_COLUMNS, TABLES


@dataclass(frozen=True)
class Lookback:
    """The last ``months`` months up to a table's own latest month.

    ``latest`` is a one-row frame with one date column. Both bounds are scalar subqueries on the bare
    date column, so Spark evaluates them first and pushes the resulting literal into the scan; there
    is no driver round trip and no value to go stale.
    """

    latest: DataFrame
    months: int

    def _bound(self) -> Column:
        return F.add_months(F.col(self.latest.columns[0]), -self.months)

    def after(self) -> Column:
        """Exclusive lower bound for a month column."""
        return self.latest.select(self._bound()).scalar()

    def first_day(self) -> Column:
        """Inclusive lower bound for raw timestamps whose month is above :meth:`after`."""
        first = F.add_months(F.trunc(self._bound(), "MM"), 1)
        return self.latest.select(first.cast("timestamp_ntz")).scalar()


class Warehouse:
    """Base class; sources override :meth:`_load` and, where they can prune better, ``rows``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _load(self, name: str, columns: list[str]) -> DataFrame:
        raise NotImplementedError

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """The table with its declared columns, or only those named."""
        wanted = columns or TABLES[name].fieldNames()
        return self._load(name, wanted).select(*wanted)

    def lookback(self, name: str, months: int) -> Lookback:
        """Window over ``name``; its anchor is the maximum of the whole table, before any filter."""
        column = MONTH_COLUMNS[name]
        return Lookback(self.table(name, [column]).agg(F.max(column).alias("latest")), months)

    def rows(self, name: str, columns: list[str], window: Lookback) -> DataFrame:
        """Rows of a monthly table inside ``window``, which may be anchored on another table."""
        month = MONTH_COLUMNS[name]
        wanted = columns if month in columns else [*columns, month]
        return self.table(name, wanted).where(F.col(month) > window.after()).select(*columns)

    def recent(self, name: str, months: int, columns: list[str]) -> DataFrame:
        """Rows of the last ``months`` months of the table itself."""
        return self.rows(name, columns, self.lookback(name, months))

    def sites(self, city: str | tuple[str, ...] | None, *columns: str) -> DataFrame:
        """Locations with id, city and ``columns``, of the given city or cities only."""
        sites = self.table("location_master", ["location_id", "city", *columns])
        wanted = (city,) if isinstance(city, str) else city
        return sites.where(F.col("city").isin(*wanted)) if wanted else sites

    def register(self, names: list[str] | None = None) -> None:
        """Expose tables to SQL as temporary views."""
        for name in names or TABLES:
            self.table(name).createOrReplaceTempView(name)

    def materialise(self, root: str, names: list[str] | None = None) -> None:
        """Write every table (or those named) as parquet under ``root``; monthly tables are split by month.

        A large derived warehouse is built once this way and then read through
        :class:`ParquetWarehouse`, where a look-back prunes whole month folders.
        """
        for name in names or TABLES:
            frame = self.table(name)
            if name in MONTH_COLUMNS:
                month = MONTH_COLUMNS[name]
                # few files per month, yet a hot month is split over several writers
                frame.hint("rebalance", F.col(month)).write.mode("overwrite").partitionBy(
                    month
                ).parquet(f"{root}/{name}")
            else:
                frame.write.mode("overwrite").parquet(f"{root}/{name}")


class ParquetWarehouse(Warehouse):
    """One parquet folder per table below ``root``.

    Numbers keep the precision of the files. A table's schema is read from a single footer, once.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        self.root = root
        self._schemas: dict[str, T.StructType] = {}
        self._latest: dict[str, str | None] = {}

    def _load(self, name: str, columns: list[str]) -> DataFrame:
        path = f"{self.root}/{name}"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def lookback(self, name: str, months: int) -> Lookback:
        """The latest month without reading a row, found once for each table.

        A table split by month tells it by the names of its folders, any other by the statistics of its files.
        """
        if name not in self._latest:
            column = MONTH_COLUMNS[name]
            folder = re.compile(rf"/{column}=(\d{{4}}-\d{{2}}-\d{{2}})/")
            found = [folder.search(file) for file in self._load(name, [column]).inputFiles()]
            split = bool(found) and all(found)
            self._latest[name] = max(m[1] for m in found) if split else self._latest_in_footers(name)
        latest = self._latest[name]
        if latest is None:
            return super().lookback(name, months)
        return Lookback(self.spark.range(1).select(F.lit(latest).cast("date").alias("latest")), months)

    def latest_by_footers(self, name: str) -> DataFrame:
        """The maximum of the month column as one row, pushed down to the footers of the files.

        Only the newer parquet source can do so; it is switched on in a session of its own, so that
        no other query changes.
        """
        aside = self.spark.newSession()
        aside.conf.set("spark.sql.sources.useV1SourceList", "")
        aside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        column = MONTH_COLUMNS[name]
        return aside.read.schema(self._load(name, [column]).schema).parquet(f"{self.root}/{name}").agg(
            F.max(column).alias("latest")
        )

    def _latest_in_footers(self, name: str) -> str | None:
        try:
            latest = self.latest_by_footers(name).first()[0]
        except (PySparkException, Py4JError):  # files without statistics: the date column is read
            return None
        return None if latest is None else str(latest)


class FrameWarehouse(Warehouse):
    """Tables handed over as frames, for fixtures or for data from other connectors."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        super().__init__(spark)
        self.frames = frames

    def _load(self, name: str, columns: list[str]) -> DataFrame:
        return self.frames[name]
