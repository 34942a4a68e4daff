"""Bulk key lookups: any number of ids in one job instead of one call per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(rows: DataFrame, key: str | list[str], order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of every key.

    Spark turns the rank filter into a group limit before the shuffle, so at most ``count`` rows of a
    key leave each task however many the key has.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= count)


def first_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return top_per_key(rows, key, order, 1).drop("_rank")


def find(ids: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per id: the first match with ``found`` true, or NULLs with ``found`` false.

    Rows of other ids are dropped before ranking, against the distinct ids, so an id asked for very
    often is folded in each task. No side is hinted: Spark broadcasts the ids while they are under its
    size threshold, and shuffles both sides by key beyond it, once for all three steps.
    """
    wanted = ids.select(key)
    matches = first_per_key(rows.join(wanted.distinct(), key, "left_semi"), key, order)
    return (
        wanted.join(matches.withColumn("found", F.lit(True)), key, "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )
