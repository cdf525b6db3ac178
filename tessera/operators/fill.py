"""Filling the gaps of two-dimensional fields.

Fields are rows (keys..., ix, iy, value). Linear filling and one LOESS pass are expressions over
windows and joins. The relaxation solvers need all of one field at once: each field (group of
``by``) is one numpy task, and many fields run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import _real


def _line(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Linear interpolation along ``order`` between known values; beyond the ends by the slope from
    the first to the last known value."""
    w = Window.partitionBy(*by).orderBy(order)
    back, ahead, all_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*by)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(order).alias("p"), F.col("value").alias("v")))
    d = df.withColumns({"__a": F.last(known, True).over(back), "__b": F.first(known, True).over(ahead), "__f": F.min(known).over(all_), "__l": F.max(known).over(all_)})
    a, b, f, la = (F.col(c) for c in ("__a", "__b", "__f", "__l"))
    slope = F.when(la["p"] > f["p"], (la["v"] - f["v"]) / (la["p"] - f["p"])).otherwise(0.0)
    inner = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["p"]) / (b["p"] - a["p"])
    v = F.coalesce(F.col("value"), F.when(a.isNotNull() & b.isNotNull(), inner).when(a.isNotNull(), la["v"] + slope * (F.col(order) - la["p"])).when(b.isNotNull(), f["v"] + slope * (F.col(order) - f["p"])))
    return d.withColumn(out, v).drop("__a", "__b", "__f", "__l")


def vector(df: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    return _line(df.withColumn("value", _real(F.col(value))), list(by), order, "filled")


def matrix(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Along each row (over iy), then rows without any value along columns (over ix)."""
    rows = _line(df.withColumn("value", _real(F.col(value))), [*by, "ix"], "iy", "r")
    cols = _line(rows.drop("value").withColumnRenamed("r", "value"), [*by, "iy"], "ix", "filled")
    return cols.drop("value")


def _edge(i: Column, n: int, periodic: bool) -> Column:
    if periodic or n == 1:
        return F.pmod(i, F.lit(n))
    m = F.pmod(i, F.lit(2 * n - 2))
    return F.least(m, F.lit(2 * n - 2) - m)


def loess(df: DataFrame, value: str, nx: int, ny: int, shape: tuple[int, int], by: list[str] = (), value_type: str = "undefined", is_periodic: bool = False) -> DataFrame:
    """One pass: the tri-cube weighted mean of the known values within nx columns and ny rows.

    ``value_type``: fill the ``undefined``, smooth the ``defined``, or do ``all``. Each known value
    is sent to the cells it reaches, beyond the edges to the mirrored (or in x the opposite) cells;
    the sums are combined before they are shuffled."""
    if value_type not in ("undefined", "defined", "all"):
        raise ValueError(f"no value type {value_type!r}")
    rows = df.select(*by, "ix", "iy", _real(F.col(value)).alias("value"))
    sx, sy = shape

    def sources(p: str, n: int, half: int, periodic: bool, name: str) -> Column:
        """Targets of a source along one axis: (target, offset) for each window position that
        reads this source."""
        at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.transform(F.filter(F.sequence(F.lit(-half), F.lit(half)), lambda o: _edge(t + o, n, periodic) == F.col(p)), lambda o: F.struct(t.cast("long").alias(name), o.alias(f"o{name}"))))
        near = F.flatten(at)
        return near

    known = rows.where("value is not null")
    tx = known.select("ix").distinct().select("ix", F.explode(sources("ix", sx, nx, is_periodic, "tx")).alias("e")).select("ix", "e.*")
    ty = known.select("iy").distinct().select("iy", F.explode(sources("iy", sy, ny, False, "ty")).alias("e")).select("iy", "e.*")
    ex = known.join(tx, "ix").join(ty, "iy")
    dist = F.sqrt((F.col("otx") / (nx + 1)) * (F.col("otx") / (nx + 1)) + (F.col("oty") / (ny + 1)) * (F.col("oty") / (ny + 1)))
    cube = 1 - dist * dist * dist
    w = F.when(dist <= 1, cube * cube * cube).otherwise(0.0)
    sums = ex.withColumn("w", w).groupBy(*by, F.col("tx").alias("ix"), F.col("ty").alias("iy")).agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("smooth"))
    out = rows.join(sums, [*by, "ix", "iy"], "left")
    v = {"undefined": F.coalesce("value", "smooth"), "defined": F.when(F.col("value").isNotNull(), F.col("smooth")), "all": F.col("smooth")}[value_type]
    return out.select(*by, "ix", "iy", v.alias("filled"))


# solvers on one field


def first_guess(z: np.ndarray, kind: str = "zonal") -> np.ndarray:
    """Gaps by the mean of their latitude band (iy), of all, or by zero."""
    out, gap = z.copy(), np.isnan(z)
    if kind == "zonal":
        n = (~gap).sum(0)
        mean = np.where(n > 0, np.nansum(z, 0) / np.maximum(n, 1), 0.0)
        out[gap] = np.broadcast_to(mean, z.shape)[gap]
    elif kind == "global":
        out[gap] = np.nanmean(z) if (~gap).any() else 0.0
    else:
        out[gap] = 0.0
    return out


def _around(u: np.ndarray, periodic: bool) -> np.ndarray:
    """Sum of the four neighbours; edges mirror, or in x wrap."""
    p = np.pad(u, ((1, 1), (0, 0)), "wrap") if periodic else (np.pad(u, ((1, 1), (0, 0)), "reflect") if u.shape[0] > 1 else np.repeat(u, 3, 0))
    q = np.pad(u, ((0, 0), (1, 1)), "reflect") if u.shape[1] > 1 else np.repeat(u, 3, 1)
    return p[:-2] + p[2:] + q[:, :-2] + q[:, 2:]


def solve_gauss_seidel(z, iterations=2000, epsilon=1e-4, relaxation=1.0, guess="zonal", is_periodic=False):
    """Red-black relaxation of Laplace's equation in the gaps: field, iterations, largest residual."""
    gap = np.isnan(z)
    u = first_guess(z, guess)
    if not gap.any():
        return u, 0, 0.0
    colour = np.add.outer(np.arange(z.shape[0]), np.arange(z.shape[1])) % 2
    residual = 0.0
    for it in range(1, iterations + 1):
        residual = 0.0
        for c in (0, 1):
            m = gap & (colour == c)
            r = _around(u, is_periodic)[m] / 4 - u[m]
            u[m] += relaxation * r
            residual = max(residual, float(np.abs(r).max(initial=0.0)))
        if residual < epsilon:
            break
    return u, it, residual


def smooth(u, rhs, gap, n, is_periodic=False):
    colour = np.add.outer(np.arange(u.shape[0]), np.arange(u.shape[1])) % 2
    for _ in range(n):
        for c in (0, 1):
            m = gap & (colour == c)
            u[m] = (_around(u, is_periodic)[m] + rhs[m]) / 4
    return u


def defect(u, rhs, gap, is_periodic=False):
    return np.where(gap, rhs + _around(u, is_periodic) - 4 * u, 0.0)


def cycle(u, rhs, gap, pre, post, is_periodic=False):
    """One V-cycle: smooth, solve the defect on half the points, smooth."""
    if min(u.shape) <= 4 or not gap.any():
        return smooth(u, rhs, gap, 50, is_periodic)
    u = smooth(u, rhs, gap, pre, is_periodic)
    r = defect(u, rhs, gap, is_periodic)
    low = r[::2, ::2] * 4  # the coarse cells are twice as wide
    e = cycle(np.zeros_like(low), low, gap[::2, ::2], pre, post, is_periodic)
    up = np.repeat(np.repeat(e, 2, 0), 2, 1)[: u.shape[0], : u.shape[1]]
    trial = np.where(gap, u + up, u)
    if np.abs(defect(trial, rhs, gap, is_periodic)).sum() < 2 * np.abs(r).sum():
        u = trial
    return smooth(u, rhs, gap, post, is_periodic)


def solve_multigrid(z, iterations=100, epsilon=1e-4, pre=2, post=2, guess="zonal", is_periodic=False):
    """V-cycles for the same equation: smooth, solve the residual on half the points, smooth."""
    gap = np.isnan(z)
    u = first_guess(z, guess)
    if not gap.any():
        return u, 0, 0.0
    zero, res = np.zeros_like(u), 0.0
    for it in range(1, iterations + 1):
        u = cycle(u, zero, gap, pre, post, is_periodic)
        res = float(np.abs(defect(u, zero, gap, is_periodic)).max() / 4)
        if res < epsilon:
            break
    return u, it, res


def low_pass(u, axis: int, sigma: float, wrap: bool):
    """Along one axis, frequencies times exp(-k * k / 2 / sigma / sigma): k counts waves of a circle, or
    half waves of a mirrored line."""
    n = u.shape[axis]
    w = u if wrap else np.concatenate([u, np.flip(u, axis)], axis)
    f = np.fft.rfft(w, axis=axis)
    k = np.exp(-(np.arange(f.shape[axis]) ** 2) / (2 * sigma * sigma))
    s = np.fft.irfft(f * (k[:, None] if axis == 0 else k), w.shape[axis], axis=axis)
    return s[:n] if axis == 0 else s[:, :n]


def solve_fft(z, iterations=500, epsilon=1e-4, sigma=10.0, guess="zonal", is_periodic=False):
    """Repeated Gaussian low pass in frequency space, ``sigma`` in numbers of waves (of a circle in a
    periodic x, else of mirrored ends), known cells put back."""
    gap = np.isnan(z)
    u = first_guess(z, guess)
    if not gap.any():
        return u, 0, 0.0
    residual = 0.0
    for it in range(1, iterations + 1):
        s = low_pass(low_pass(u, 0, sigma, is_periodic), 1, sigma, is_periodic)
        residual = float(np.abs(s[gap] - u[gap]).max())
        u[gap] = s[gap]
        if residual < epsilon:
            break
    return u, it, residual


def solve_loess(z, nx=3, ny=3, iterations=500, epsilon=1e-4, guess="global", is_periodic=False):
    """LOESS repeated from a first guess until the gaps change by less than epsilon."""
    gap = np.isnan(z)
    u = first_guess(z, guess)
    if not gap.any():
        return u, 0, 0.0
    ox, oy = np.arange(-nx, nx + 1), np.arange(-ny, ny + 1)
    d = np.hypot(*np.meshgrid(ox / (nx + 1), oy / (ny + 1), indexing="ij"))
    w = np.where(d <= 1, (1 - d**3) ** 3, 0.0)
    mirror = lambda i, n: np.minimum(i % max(2 * n - 2, 1), (2 * n - 2) - i % max(2 * n - 2, 1)) if n > 1 else i * 0
    rx = [(np.arange(z.shape[0]) + o) % z.shape[0] if is_periodic else mirror(np.arange(z.shape[0]) + o, z.shape[0]) for o in ox]
    ry = [mirror(np.arange(z.shape[1]) + o, z.shape[1]) for o in oy]
    residual = 0.0
    for it in range(1, iterations + 1):
        s = sum(w[i, j] * u[np.ix_(a, b)] for i, a in enumerate(rx) for j, b in enumerate(ry)) / w.sum()
        residual = float(np.abs(s[gap] - u[gap]).max())
        u[gap] = s[gap]
        if residual < epsilon:
            break
    return u, it, residual


SOLVERS = {"gauss_seidel": solve_gauss_seidel, "multigrid": solve_multigrid, "fft_inpaint": solve_fft, "loess": solve_loess}


def solve(df: DataFrame, value: str, method: str, by: list[str], **options) -> DataFrame:
    """(by..., ix, iy, filled, iterations, residual), one task for each field."""
    f = SOLVERS[method]
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ix, iy = g["ix"].to_numpy(int), g["iy"].to_numpy(int)
        z = np.full((ix.max() + 1, iy.max() + 1), np.nan)
        z[ix, iy] = g["v"].to_numpy(float)
        u, n, r = f(z, **options)
        return g[[*by, "ix", "iy"]].assign(filled=u[ix, iy], iterations=n, residual=r)

    rows = df.select(*by, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), _real(F.col(value)).alias("v"))
    return rows.groupBy(*by).applyInPandas(run, f"{types}, ix long, iy long, filled double, iterations long, residual double")
