"""Small numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(x: Column, period: float) -> Column:
    """Of the sign of the period."""
    return F.pmod(x, F.lit(float(period)))


def normalize_period(x: Column, low: float, period: float) -> Column:
    """Into [low, low + period)."""
    return F.pmod(x - low, F.lit(float(period))) + low


def normalize_half(x: Column, period: float) -> Column:
    """Into [-period / 2, period / 2)."""
    return normalize_period(x, -period / 2, period)


def sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-15, F.lit(1.0)).otherwise(F.sin(math.pi * x) / (math.pi * x))


def sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def is_almost_zero(x: Column, epsilon: float = 1e-12) -> Column:
    return F.abs(x) < epsilon


def is_same(x: Column, y: Column, epsilon: float = 1e-12) -> Column:
    return F.abs(x - y) <= epsilon


def sqr(x: Column) -> Column:
    return x * x
