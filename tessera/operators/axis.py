"""Strictly monotonic coordinate axes and lookups on them.

An ``Axis`` is driver metadata; lookups are Column expressions. Evenly spaced axes are arithmetic.
Uneven ones search a literal array, up to ``SMALL`` points in the JVM, beyond by a vectorised
search in an Arrow UDF. Missing coordinates are NULL or NaN and find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import UNITS
from tessera.functions.let import let

SMALL = 64


def _lit(xs) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


@dataclass(frozen=True)
class Axis:
    values: tuple[float, ...]
    period: float | None = None
    epsilon: float = 1e-6
    regular: bool = field(init=False)
    step: float | None = field(init=False)

    def __post_init__(self):
        v = np.asarray(self.values, float)
        if not len(v):
            raise ValueError("an axis needs a point")
        if self.period and len(v) > 1:  # one break of the period is unwrapped
            turn = np.flatnonzero(np.sign(np.diff(v)) != np.sign(v[-1] - v[0]) if len(v) > 2 else [False])
            jump = np.flatnonzero(np.abs(np.diff(v)) > self.period / 2)
            if len(jump) == 1 and len(turn) <= len(v):
                k = jump[0] + 1
                v = v.copy()
                v[k:] += self.period * -np.sign(v[k] - v[k - 1])
        d = np.diff(v)
        if len(v) > 1 and not ((d > 0).all() or (d < 0).all()):
            raise ValueError("axis values must be strictly monotonic")
        even = len(v) == 1 or np.abs(np.linspace(v[0], v[-1], len(v)) - v).max() <= self.epsilon
        object.__setattr__(self, "values", tuple(v.tolist()))
        object.__setattr__(self, "regular", bool(even))
        object.__setattr__(self, "step", (float((v[-1] - v[0]) / (len(v) - 1)) if len(v) > 1 else 1.0) if even else None)

    @classmethod
    def linspace(cls, start: float, step: float, n: int, period: float | None = None) -> Axis:
        return cls(tuple(start + step * i for i in range(n)), period)

    @classmethod
    def from_column(cls, df: DataFrame, column: str, period: float | None = None, limit: int = 1_000_000) -> Axis:
        """From the distinct values of a column; an axis of more than ``limit`` points is refused."""
        got = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").distinct().orderBy("v").limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"more than {limit} distinct coordinates")
        return cls(tuple(r.v for r in got), period)

    # metadata
    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i):
        return self.values[i]

    def __iter__(self):
        return iter(self.values)

    @property
    def ascending(self) -> bool:
        return len(self) < 2 or self.values[-1] > self.values[0]

    @property
    def periodic(self) -> bool:
        """A period counts only if the axis spans it whole."""
        if not self.period or len(self) < 2:
            return False
        gap = abs(self.period) - abs(self.values[-1] - self.values[0])
        last = abs(self.values[-1] - self.values[-2])
        return abs(gap - (abs(self.step) if self.regular else last)) <= max(1e-6, 0.5 * last)

    def front(self) -> float:
        return self.values[0]

    def back(self) -> float:
        return self.values[-1]

    def min_value(self) -> float:
        return min(self.values)

    def max_value(self) -> float:
        return max(self.values)

    def increment(self) -> float:
        if not self.regular:
            raise ValueError("the axis is not regular")
        return self.step

    def is_ascending(self) -> bool:
        return self.ascending

    def is_regular(self) -> bool:
        return self.regular

    def is_periodic(self) -> bool:
        return self.periodic

    def flip(self) -> Axis:
        return Axis(self.values[::-1], self.period, self.epsilon)

    def __eq__(self, other) -> bool:
        return isinstance(other, Axis) and self.values == other.values and self.period == other.period

    __hash__ = object.__hash__

    def to_dataframe(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, v) for i, v in enumerate(self.values)], "idx int, coord double")

    # lookups
    def normalize(self, c: Column) -> Column:
        c = c.cast("double")
        return F.pmod(c - self.min_value(), F.lit(float(self.period))) + self.min_value() if self.period else c

    def contains(self, c: Column) -> Column:
        c = c.cast("double")
        real = c.isNotNull() & ~F.isnan(c)
        return real if self.periodic else real & (c >= self.min_value()) & (c <= self.max_value())

    def coordinate(self, i: Column) -> Column:
        if self.regular:
            return F.lit(self.values[0]) + i * F.lit(self.step)
        return self._at(np.array(self.values), i)

    @staticmethod
    def _at(points: np.ndarray, i: Column) -> Column:
        """A point by index: of a short list in the JVM, of a long one by an Arrow UDF."""
        if len(points) <= SMALL:
            return F.get(_lit(points), i.cast("int"))

        @F.pandas_udf("double")
        def take(k: pd.Series) -> pd.Series:
            k = k.to_numpy(float)
            ok = (k >= 0) & (k < len(points))
            return pd.Series(np.where(ok, points[np.where(ok, k, 0).astype(int)], np.nan)).astype(object).where(ok, None)

        return take(i)

    def _below(self, c: Column) -> Column:
        """How many axis points are <= c, counted from the low end."""
        up = sorted(self.values)
        if len(up) <= SMALL:
            return F.size(F.filter(_lit(up), lambda e: e <= c)).cast("long")
        points = np.array(up)

        @F.pandas_udf("long")
        def search(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(points, x.to_numpy(float), "right"))

        return search(c)

    def _mapped(self, k: Column) -> Column:
        return k if self.ascending else F.lit(len(self) - 1) - k

    def find_index(self, c: Column, bounded: bool = False) -> Column:
        """The nearest point: of an even axis by rounding half away from zero, of an uneven one the
        upper of two that are equally near; -1 outside, or the edge if ``bounded``."""
        n, raw = len(self), c.cast("double")
        c = self.normalize(raw) if self.periodic else raw
        missing = raw.isNull() | F.isnan(raw)
        if self.regular:
            k = F.round((c - self.values[0]) / self.step).cast("long")
            k = F.pmod(k, F.lit(n)) if self.periodic else (F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)) if bounded else F.when((k < 0) | (k >= n), F.lit(-1)).otherwise(k))
            return F.when(missing, F.lit(-1)).otherwise(k).cast("long")
        up = sorted(self.values)
        below = self._below(c)
        lo, hi = F.greatest(below - 1, F.lit(0)), F.least(below, F.lit(n - 1))
        at = lambda i: self._at(np.array(up), i)
        near = F.when(at(hi) - c <= c - at(lo), hi).otherwise(lo)
        inside = (c >= up[0]) & (c <= up[-1])
        if self.periodic:
            to_last, to_first = c - up[-1], F.lit(up[0] + abs(self.period)) - c
            k = F.when(inside, near).when(to_first <= to_last, F.lit(0)).otherwise(F.lit(n - 1))
        elif bounded:
            k = F.when(c < up[0], F.lit(0)).when(c > up[-1], F.lit(n - 1)).otherwise(near)
        else:
            k = F.when(inside, near)
        return F.coalesce(F.when(missing, F.lit(None).cast("long")).otherwise(self._mapped(k)), F.lit(-1)).cast("long")

    def find_indexes(self, c: Column) -> Column:
        """The bracketing pair as struct (i0, i1); NULL outside. A point on the axis pairs with the
        next one, the last with the one before; a periodic axis closes with (n - 1, 0)."""
        n, raw = len(self), c.cast("double")
        c = self.normalize(raw) if self.periodic else raw
        real = raw.isNotNull() & ~F.isnan(raw)
        if self.regular:
            k = F.floor((c - self.values[0]) / self.step).cast("long")
            inside = (k >= 0) & ((c - self.values[0]) / self.step <= n - 1)
        else:
            k = self._below(c) - 1
            inside = (k >= 0) & (c <= max(self.values))
            if not self.ascending:  # count from the other end, exact points belong to the next pair
                exact = self._at(np.sort(np.array(self.values)), k) == c
                k = F.when(exact, F.lit(n - 1) - k).otherwise(F.lit(n - 2) - k)
        pair = lambda a, b: F.struct(a.cast("long").alias("i0"), b.cast("long").alias("i1"))
        end = F.lit(n - 1)
        out = F.when(~real, None)
        if self.periodic:
            return out.when(~inside | (k >= n - 1), pair(end, F.lit(0))).otherwise(pair(k, k + 1))
        return out.when(inside & (k >= n - 1), pair(F.lit(max(n - 2, 0)), end)).when(inside, pair(k, k + 1))

    def window(self, c: Column, half: int, boundary: str = "undef") -> Column:
        """The 2 * half indices around the bracket, as an array of longs. Beyond the ends:
        ``undef`` gives NULL, ``shrink`` a shorter window, ``expand`` the edge again, ``sym`` the
        mirrored points, ``wrap`` the other end; a periodic axis always wraps."""
        if half < 1:
            raise ValueError("half must be 1 or more")
        if boundary not in ("undef", "shrink", "expand", "sym", "wrap"):
            raise ValueError(f"no boundary {boundary!r}")

        def around(pair: Column) -> Column:
            base = F.when(pair["i1"] == 0, F.lit(len(self) - 1)).otherwise(pair["i0"])
            return F.when(pair.isNotNull(), self.window_at(base, half, boundary))

        return let(self.find_indexes(c), around)

    def window_at(self, lower: Column, half: int, boundary: str = "undef") -> Column:
        """The window around the bracket whose lower index is given."""
        n = len(self)

        def bounded(ids: Column) -> Column:
            if self.periodic or boundary == "wrap":
                return F.transform(ids, lambda i: F.pmod(i, F.lit(n)))
            if boundary == "expand":
                return F.transform(ids, lambda i: F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)))
            if boundary == "sym":
                around = max(2 * n - 2, 1)
                return F.transform(ids, lambda i: F.least(F.pmod(i, F.lit(around)), F.lit(2 * n - 2) - F.pmod(i, F.lit(around))))
            inside = lambda i: (i >= 0) & (i < n)
            return F.filter(ids, inside) if boundary == "shrink" else F.when(F.forall(ids, inside), ids)

        return let(F.transform(F.sequence(F.lit(1 - half), F.lit(half)), lambda o: lower + o), bounded)

    def windows(self, lower: np.ndarray, half: int, boundary: str = "undef") -> tuple[np.ndarray, np.ndarray]:
        """The same for arrays: indices (N, 2 * half), and which of them are in the window."""
        n, ids = len(self), lower[:, None] + np.arange(1 - half, half + 1)
        inside = (ids >= 0) & (ids < n)
        if self.periodic or boundary == "wrap":
            return ids % n, np.ones_like(inside)
        if boundary == "expand":
            return np.clip(ids, 0, n - 1), np.ones_like(inside)
        if boundary == "sym":
            turned = ids % max(2 * n - 2, 1)
            return np.minimum(turned, 2 * n - 2 - turned), np.ones_like(inside)
        return np.clip(ids, 0, n - 1), inside if boundary == "shrink" else inside & inside.all(1, keepdims=True)


class TemporalAxis(Axis):
    """An axis of timestamps, as whole ticks of microseconds; lookups take timestamp columns. ``unit``
    (s, ms or us) is its resolution."""

    unit = "us"

    @classmethod
    def from_range(cls, start_us: int, step_us: int, n: int, unit: str = "us") -> TemporalAxis:
        axis = cls(tuple(float(start_us + step_us * i) for i in range(n)), None, 0.0)
        if start_us % cls._tick(unit) or step_us % cls._tick(unit):
            raise ValueError(f"points are no whole {unit}")
        object.__setattr__(axis, "unit", unit)
        return axis

    @staticmethod
    def _tick(unit: str) -> int:
        return 1_000_000 // UNITS[unit]

    @property
    def dtype(self) -> str:
        return f"timestamp[{self.unit}]"

    def cast_to_temporal_axis(self, ts: Column) -> Column:
        """Timestamps at the axis' resolution, finer parts cut off."""
        tick = self._tick(self.unit)
        us = F.unix_micros(ts.cast("timestamp"))
        return F.timestamp_micros(us - F.pmod(us, F.lit(tick)))

    @staticmethod
    def ticks(ts: Column) -> Column:
        return F.unix_micros(ts.cast("timestamp")).cast("double")

    def normalize(self, c: Column) -> Column:
        return c.cast("double")

    def find_time_index(self, ts: Column, bounded: bool = False) -> Column:
        return self.find_index(self.ticks(ts), bounded)

    def find_time_indexes(self, ts: Column) -> Column:
        return self.find_indexes(self.ticks(ts))
