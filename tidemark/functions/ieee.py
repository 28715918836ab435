"""Arithmetic of doubles beyond the finite ones, where Spark's own gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def divided(a: Column, b: Column) -> Column:
    """a / b: infinite where only b is 0, not a number where both are."""
    return F.when(b == 0, a.cast("double") * F.lit(INF)).otherwise(F.try_divide(a, b))


def logarithm(x: Column) -> Column:
    """The natural logarithm: minus infinity of 0, not a number below."""
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def floored(x: Column) -> Column:
    """The floor as a double, so that infinite values stay what they are."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(F.floor(x).cast("double"))
