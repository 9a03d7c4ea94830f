"""Scalar column helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (IEEE double)."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return value


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def null_to_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("nan")))


def zero_if_missing(value: Column) -> Column:
    """NULL and NaN become 0.0."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def total(values: list[Column]) -> Column:
    return reduce(lambda left, right: left + right, values)


def largest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def first_argmax(values: list[Column]) -> Column:
    """Index of the first maximum."""
    top = largest(values)
    chain = F.when(values[0] == top, F.lit(0))
    for i, value in enumerate(values[1:], start=1):
        chain = chain.when(value == top, F.lit(i))
    return chain


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
