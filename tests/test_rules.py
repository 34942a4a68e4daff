"""Rounding, null, ratio and date rules."""

import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from memberlens.functions.clock import micros_of
from memberlens.functions.rules import (
    decoded_text, flag, mean, months_between_boundaries, number, percent, ratio, to_fixed, whole,
)


def exact(value, digits):
    step = Decimal(1).scaleb(-digits)
    size = Decimal(abs(value)).quantize(step, rounding=ROUND_HALF_UP)
    return float(size if value >= 0 else -size) + 0.0


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_to_fixed_rounds_the_binary_value(spark, digits):
    rnd = random.Random(digits)
    values = [1.005, 1.45, 12.25, 12.35, 0.125, 2.675, 0.0, -1.005, -0.001, -12.25, 1e15 + 0.3, 1e17]
    values += [rnd.randrange(10**6) / 20 for _ in range(800)]
    values += [rnd.randrange(10**6) / 2000 for _ in range(800)]
    values += [rnd.uniform(-1e6, 1e6) for _ in range(800)]
    values += [rnd.uniform(0, 1) * 10 ** rnd.randrange(12) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in rows.select("v", to_fixed(F.col("v"), digits)).collect()]
    wrong = [(v, r, exact(v, digits)) for v, r in got if r != exact(v, digits)]
    assert wrong == []


def test_to_fixed_keeps_null_and_has_no_negative_zero(frame):
    rows = frame("v double", (None,), (-0.001,)).select(to_fixed(F.col("v"), 2)).collect()
    assert rows[0][0] is None
    assert str(rows[1][0]) == "0.0"


def test_edge_casts(frame):
    row = frame("a double, b long, c boolean", (None, None, None)).select(
        number("a"), whole("b"), flag("c")
    ).first()
    assert tuple(row) == (0.0, 0, False)


def test_ratio_guards_zero_negative_and_null(frame):
    rows = frame("n double, d double", (1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, None))
    n, d = F.col("n"), F.col("d")
    got = rows.select(ratio(n, d), ratio(n, d, otherwise=None), percent(n, d), mean(n, d)).collect()
    assert [tuple(r) for r in got] == [
        (0.5, 0.5, 50.0, 0.5), (0.0, None, 0.0, None), (0.0, None, 0.0, None), (0.0, None, 0.0, None),
    ]


def test_month_difference_counts_boundaries(frame):
    rows = frame(
        "a date, b date",
        (date(2024, 1, 31), date(2024, 2, 1)),
        (date(2024, 1, 1), date(2024, 1, 31)),
        (date(2023, 12, 31), date(2025, 1, 1)),
        (date(2024, 1, 1), None),
    ).select(months_between_boundaries(F.col("a"), F.col("b")))
    assert [r[0] for r in rows.collect()] == [1, 0, 13, None]


def test_variant_text_loses_its_quotes(frame):
    rows = frame("j string", ('"London"',)).select(F.parse_json("j").alias("v"))
    assert rows.select(decoded_text("v")).first()[0] == "London"


def test_micros_ignore_the_session_time_zone(spark, frame):
    rows = frame("t timestamp_ntz", (datetime(2024, 3, 31, 2, 30, 0, 5),))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = rows.select(micros_of(rows, "t")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == 1711852200000005
