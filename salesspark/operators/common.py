"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesspark.schema import VIEW_COLUMNS


def money_sum(col: str) -> Column:
    """Exact (decimal) sum, DOUBLE at the output."""
    return F.sum(col).cast("double")


def pct(numerator: Column, denominator: Column) -> Column:
    """100 * n / d with NULL for a zero or NULL denominator (SQL ``NULLIF``)."""
    return F.try_divide(F.lit(100.0) * numerator.cast("double"), denominator.cast("double"))


def safe_ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """n / d, ``default`` when d is 0 or NULL (the reference's ``safe_divide``)."""
    d = denominator.cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(numerator.cast("double") / d)


def check_column(name: str, allowed=VIEW_COLUMNS) -> str:
    """Dimension / metric names become identifiers, so only whitelisted ones pass."""
    if name not in allowed:
        raise ValueError(f"{name!r} is not one of {sorted(allowed)}")
    return name

