"""Calendar parts of timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of a unit in a second (fixed values)
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def date(ts: Column) -> Column:
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"))


def time(ts: Column) -> Column:
    return F.struct(F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"))


def isocalendar(ts: Column) -> Column:
    """ISO year, week and weekday (Monday 1)."""
    return F.struct(F.extract(F.lit("YEAROFWEEK"), ts).alias("iso_year"), F.weekofyear(ts).alias("iso_week"), (F.weekday(ts) + 1).alias("iso_weekday"))


def weekday(ts: Column) -> Column:
    """Days since Sunday."""
    return F.dayofweek(ts) - 1


def since_january(ts: Column) -> Column:
    """Microseconds since the first of January, 0:00."""
    stamp = ts.cast("timestamp")
    return F.unix_micros(stamp) - F.unix_micros(F.date_trunc("year", stamp))


def convert_ticks(ticks: Column, source: str, target: str) -> Column:
    """Whole ticks of one unit in another, floored; overflow is an error under ANSI."""
    a, b = UNITS[source], UNITS[target]
    return ticks * F.lit(b // a) if b >= a else F.floor(ticks / F.lit(a // b)).cast("long") if a // b > 1 else ticks


def finer(a: str, b: str) -> str:
    return max(a, b, key=UNITS.__getitem__)
