"""Column rules every report shares: nulls, ratios, rounding, means and months."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# a share of money has further digits
SHARED_MONEY = "decimal(28,8)"


def money(column: Column | str) -> Column:
    """Exact money for summing; sums of doubles would depend on row order."""
    return _column(column).cast(MONEY)


def shared_money(column: Column | str) -> Column:
    """Exact money for summing, with the digits that shares add."""
    return _column(column).cast(SHARED_MONEY)


def number(column: Column | str) -> Column:
    """A double at the output edge, 0 where the value is missing."""
    return F.coalesce(_column(column).cast("double"), F.lit(0.0))


def whole(column: Column | str) -> Column:
    """A long at the output edge, 0 where the value is missing."""
    return F.coalesce(_column(column).cast("long"), F.lit(0).cast("long"))


def flag(column: Column | str) -> Column:
    """A boolean at the output edge, false where the value is missing."""
    return F.coalesce(_column(column).cast("boolean"), F.lit(False))


def ratio(numerator: Column, denominator: Column, otherwise: float | None = 0.0) -> Column:
    """Quotient as a double where the denominator is above zero, else ``otherwise``."""
    fallback = F.lit(otherwise).cast("double")
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(fallback)


def percent(part: Column, total: Column) -> Column:
    return ratio(part, total) * 100


def mean(total: Column, count: Column) -> Column:
    """Mean from an exact sum and a count; NULL when nothing was counted."""
    return ratio(total, count, otherwise=None)


def to_fixed(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals by the double's exact binary value, ties away from zero.

    1.005 holds slightly less than 1.005, so two digits give 1.00, as fixed-digit formatting of a
    double does; ``round(value * 100) / 100`` would give 1.01 because the product itself rounds up.
    The lost part of the product is recovered with a split multiplication, so the whole rule stays
    an arithmetic expression inside code generation.
    """
    scale = float(10**digits)
    size = F.abs(value.cast("double"))
    product = size * scale
    spread = size * 134217729.0
    high = spread - (spread - size)
    lost = (high * scale - product) + (size - high) * scale
    base = F.floor(product).cast("double")
    fraction = product - base
    step = F.when((fraction > 0.5) | ((fraction == 0.5) & (lost >= 0)), 1.0)
    # a product that was rounded up onto a whole number still lies within half a unit of it
    rounded = (base + F.coalesce(step, F.lit(0.0))) / scale
    signed = F.when(value < 0, -rounded).otherwise(rounded)
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(product >= float(2**52), value.cast("double"))
        .when(rounded == 0, F.lit(0.0))
        .otherwise(signed)
    )


def fixed(**digits: int) -> Callable[[DataFrame], DataFrame]:
    """For ``frame.transform``: round the named columns in place with :func:`to_fixed`.

    The raw values get a projection of their own, so each is computed once and the rounding works on
    plain columns; rounding an expression directly would repeat it a dozen times.
    """

    def apply(frame: DataFrame) -> DataFrame:
        return frame.withColumns(
            {name: to_fixed(F.col(name), places) for name, places in digits.items()}
        )

    return apply


def month_of(column: Column | str) -> Column:
    """First day of the month as a date."""
    return F.trunc(_column(column).cast("date"), "MM")


def months_between_boundaries(start: Column, end: Column) -> Column:
    """Month boundaries crossed from ``start`` to ``end``: Jan 31 to Feb 1 is one month."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def decoded_text(column: Column | str) -> Column:
    """Text held in a VARIANT or in a JSON-encoded string, without the quotes."""
    return F.variant_get(_column(column), "$", "string")


def as_of_date(as_of) -> Column:
    """A fixed reporting date, or today."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
