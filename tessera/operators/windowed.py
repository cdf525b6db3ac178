"""Interpolation from a window of cells around a point (the spline family).

The points' brackets are reduced to distinct cells first; each cell's window is joined from the
table of cells once, however many points lie in it, and kept as one array. Points are joined with
their window by equality, and an Arrow UDF, which knows the axes, evaluates whole batches in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .grid import Grid, _checked, bracketed

BIVARIATE = (*kernels.MINIMUM, "bicubic", "bilinear")


def _matrix(col: pd.Series, *shape: int) -> np.ndarray:
    return np.array(col.tolist(), dtype=float).reshape(len(col), *shape)


def interpolate(grid: Grid, points: DataFrame, id_: str, columns: list[str], method: str = "bicubic", half: int = 3, boundary: str = "undef", outer: str | list[str] = "linear", derivative: bool = False, bounds_error: bool = False) -> DataFrame:
    """(id, value) of each point, and ``derivative`` too on a one-dimensional grid. The first two
    axes (or the only one) use 2 * half cells each, the others their bracket, by ``outer``: linear
    or nearest. NULL outside, where the window is cut off (boundary ``undef``) or has a gap."""
    n = len(grid.axes)
    if method not in (BIVARIATE if n > 1 else kernels.MINIMUM):
        raise ValueError(f"no method {method!r} in {n} dimensions")
    if half < 1:
        raise ValueError("half must be 1 or more")
    if boundary not in ("undef", "shrink", "expand", "sym", "wrap"):
        raise ValueError(f"no boundary {boundary!r}")
    flat = min(n, 2)
    outer = [outer] * (n - flat) if isinstance(outer, str) else outer
    names = [f"k{k}" for k in range(n)]
    p = bracketed(grid.axes, points, id_, columns)
    cells = p.where(F.col("k0").isNotNull()).select(*names).distinct()
    # the window of a cell, in the order of the outer axes (the first fastest varying last), then x, y
    sides = [a.window_at(F.col(f"k{k}"), half, boundary) if k < flat else F.array(F.col(f"k{k}"), F.pmod(F.col(f"k{k}") + 1, F.lit(len(a)))) for k, a in enumerate(grid.axes)]
    ex = cells.select(*names, *[s.alias(f"w{k}") for k, s in enumerate(sides)])
    for k in range(n):  # a window that is cut off is NULL and has no rows
        ex = ex.select("*", F.posexplode(f"w{k}").alias(f"p{k}", f"i{k}"))
    ps = [f"p{k}" for k in range(n)]
    got = ex.select(*names, *ps, *grid.keys).join(grid.cells, grid.keys, "left").groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(*reversed(ps[flat:]), *ps[:flat], "value"))).alias("s"))
    ready = p.join(got.select(*names, F.transform("s", lambda s: s["value"]).alias("z")), names, "left")
    axes = grid.axes

    @F.pandas_udf("struct<value:double,slope:double>")
    def kernel(z: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        value, slope = np.full(len(z), np.nan), np.full(len(z), np.nan)
        have = np.flatnonzero(z.notna())
        ks, xs = [r.to_numpy(float)[have].astype(int) for r in rest[:n]], [r.to_numpy(float) for r in rest[n:]]
        ids = [a.windows(k, half, boundary) if j < flat else _pair(a, k) for j, (a, k) in enumerate(zip(axes, ks, strict=True))]
        shape = np.stack([ok[:, c] for _, ok in ids for c in range(ok.shape[1])], 1) if len(have) else np.empty((0, 1), bool)
        for form in np.unique(shape, axis=0):  # windows that are cut off alike
            own = np.flatnonzero((shape == form).all(1))
            at, q, nodes, size, first = have[own], [x[have[own]] for x in xs], [], [], 0
            for a, (i, ok), x in zip(axes, ids, q, strict=True):
                kept = form[first : first + ok.shape[1]]
                first += ok.shape[1]
                c = np.asarray(a.values)[i[own][:, kept]]
                if a.periodic:  # the nodes next to the point, in order
                    period = float(a.period)
                    c = c + period * np.round((x[:, None] - c) / period) if c.shape[1] <= 2 else _unwrapped(c, x, period)
                nodes.append(c)
                size.append(c.shape[1])
            planes = int(np.prod(size[flat:], dtype=int))
            v = _matrix(z.iloc[at], planes, *size[:flat])
            if n == 1:
                value[at], slope[at] = kernels.univariate(nodes[0], v[:, 0], q[0], method)
                continue
            got = np.stack([kernels.bivariate(nodes[0], nodes[1], v[:, j], q[0], q[1], method) for j in range(planes)], 1)
            for k in range(2, n):  # planes are ordered with the first outer axis fastest
                c, got = nodes[k], got.reshape(len(at), -1, 2)
                t = (q[k] - c[:, 0]) / (c[:, 1] - c[:, 0])
                t = t if outer[k - 2] == "linear" else np.where(t >= 0.5, 1.0, 0.0)
                got = got[:, :, 0] * (1 - t)[:, None] + got[:, :, 1] * t[:, None]
            value[at] = got.reshape(len(at))
        none = lambda a: pd.Series(a).astype(object).where(np.isfinite(a), None)
        return pd.DataFrame({"value": none(value), "slope": none(slope)})

    out = ready.withColumn("v", kernel("z", *names, *[f"x{k}" for k in range(n)]))
    cols = [F.col("id").alias(id_), _checked(F.col("v.value"), F.col("k0").isNotNull(), bounds_error).alias("value")]
    return out.select(*cols, *([F.col("v.slope").alias("derivative")] if derivative else []))


def _pair(axis, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.stack([lower, (lower + 1) % len(axis)], 1)
    return ids, np.ones(ids.shape, bool)


class RegularGridInterpolator:
    """One call for all methods: bilinear, idw and nearest from corners, the others from windows.
    Options of the one kind are refused with the other."""

    CORNERS = ("bilinear", "idw", "nearest")

    def __init__(self, grid: Grid):
        self.grid = grid

    def __call__(self, points: DataFrame, id_: str, columns: list[str], method: str = "bilinear", **options) -> DataFrame:
        from .grid import interpolate as corners

        windowed_only = {"half", "boundary", "derivative"} & set(options)
        if method in self.CORNERS and len(self.grid.axes) > 1:
            if windowed_only:
                raise TypeError(f"{method} takes no {', '.join(sorted(windowed_only))}")
            return corners(self.grid, points, id_, columns, method, **options)
        if "exponent" in options:
            raise TypeError(f"{method} takes no exponent")
        return interpolate(self.grid, points, id_, columns, method, **options)


def _unwrapped(c: np.ndarray, x: np.ndarray, period: float) -> np.ndarray:
    """Coordinates of a window across the seam, increasing from its first node, moved next to x."""
    d = np.diff(c, axis=1)
    c = np.concatenate([c[:, :1], c[:, :1] + np.cumsum(d - period * np.floor(d / period), 1)], 1)
    mid = c[:, c.shape[1] // 2 - 1]
    return c + (period * np.floor((x - mid) / period))[:, None]
