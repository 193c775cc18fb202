"""Small column helpers: blanks, comparisons by name, number and time formatting."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(col: Column, default: str) -> Column:
    """NULL and the empty string both become ``default``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def ratio_kpi(numerators: list[str], denominators: list[str], scale: float) -> Column:
    """Sum of counters over sum of counters, scaled; NULL if any counter is NULL or the sum is 0."""
    top = reduce(add, [F.col(c) for c in numerators]).cast("double")
    bottom = reduce(add, [F.col(c) for c in denominators])
    return F.try_divide(top, bottom) * F.lit(scale)


OPERATORS = ("lt", "le", "gt", "ge", "outside")


def known_operators(names: Iterable[str]) -> None:
    """Stop at an operator that no condition knows; it would never hold and so hide its rule."""
    unknown = sorted(set(names) - set(OPERATORS))
    if unknown:
        raise ValueError(f"unknown operators: {', '.join(map(str, unknown))}")


def compares(op: Column, value: Column, threshold: Column, high: Column | None = None) -> Column:
    """Evaluate a condition whose operator is data: lt, le, gt, ge or outside(threshold, high)."""
    test = (
        F.when(op == "lt", value < threshold)
        .when(op == "le", value <= threshold)
        .when(op == "gt", value > threshold)
        .when(op == "ge", value >= threshold)
    )
    if high is not None:
        test = test.when(op == "outside", (value < threshold) | (value > high))
    return test


def seconds_text(start: Column, end: Column) -> Column:
    """Seconds between two instants, written as a decimal number (``900.0``)."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    seconds = micros / 1_000_000
    whole = F.concat(seconds.cast("long").cast("string"), F.lit(".0"))
    return F.when(micros % 1_000_000 == 0, whole).otherwise(seconds.cast("string"))
