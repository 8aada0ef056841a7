"""Rounding, clamping and null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def round_half_away(x: Column, digits: int = 3) -> Column:
    """Round the binary product half away from zero (``F.round`` goes through decimals instead)."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def ratio(num: Column, den: Column) -> Column:
    """NULL when the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column, digits: int = 4) -> Column:
    return F.coalesce(round_half_away(ratio(num, den), digits), F.lit(0.0))


def f1_of(precision: Column, recall: Column, digits: int = 4) -> Column:
    value = F.try_divide(precision * recall * 2, precision + recall)
    return F.coalesce(round_half_away(value, digits), F.lit(0.0))


def mean_of_present(*xs: Column) -> Column:
    """Mean over the non-NULL arguments, NULL when all are NULL."""
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return ratio(total, n)


def positive_or_null(x: Column) -> Column:
    return F.when(x > 0, x)
