"""Scalar functions whose treatment of NULL, zero and non-finite values is part of the contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(pick: Column, columns: tuple[Column, ...]) -> Column:
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in columns]), F.lit(None)).otherwise(pick)


def strict_greatest(*columns: Column) -> Column:
    """NULL if any argument is NULL."""
    return _strict(F.greatest(*columns), columns)


def strict_least(*columns: Column) -> Column:
    """NULL if any argument is NULL."""
    return _strict(F.least(*columns), columns)


def divide(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def growth_log(r: Column, floor: float = 1e-6) -> Column:
    """ln(1 + r) with 1 + r kept at floor or above; NULL stays NULL."""
    return F.when(r.isNotNull(), F.ln(F.greatest(1 + r, F.lit(floor))))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
