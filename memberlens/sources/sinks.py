"""Report results as JSON rows or parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(report: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row, missing values written as null."""
    every = F.struct(*report.columns)
    return report.select(_to_json(every).alias(column))


def write_json(report: DataFrame, path: str, mode: str = "error") -> None:
    report.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(report: DataFrame, path: str, mode: str = "error") -> None:
    report.write.mode(mode).parquet(path)


def _to_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})
