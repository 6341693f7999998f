"""Boolean, truthiness and rounding helpers with the semantics of the scored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strictly(*conditions: Column) -> Column:
    """All conditions are true; an unknown one counts as false."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def text_or(*cols: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def rate(n: Column, denominator: Column) -> Column:
    """n / denominator rounded to six digits; zero where there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.round(n / denominator, 6))


def money(c: Column) -> Column:
    """Exact sums need decimals."""
    return c.cast("decimal(18,4)")


def mean_of(c: Column) -> Column:
    """Mean over the rows that have a value, from an exact sum; zero where there are none."""
    return rate(F.sum(money(c)).cast("double"), F.count(c))
