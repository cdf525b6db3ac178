"""Estimates from scattered observations, over the rows of a nearest-neighbour join.

Input rows: qid, distance, value, and where solvers need them the coordinates. Weighted means are
grouped expressions. Solvers work on the few neighbours of a query as arrays, batches of queries
with equal numbers of neighbours in one numpy call.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COINCIDENT = 1e-6


def inverse_distance(neighbours: DataFrame, qid: str = "qid", exponent: float = 2.0) -> DataFrame:
    """(qid, value, neighbours): of a coincident observation its own value."""
    d = F.col("distance")
    near = d < COINCIDENT
    w = F.when(~near, 1 / F.pow(d, F.lit(exponent)))
    return neighbours.groupBy(qid).agg(F.coalesce(F.min_by(F.when(near, F.col("value")), F.when(near, d)), F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.count("*").alias("neighbours"))


def _cosines(coefficients: tuple[float, ...]):
    def f(d: Column, r: Column, arg) -> Column:
        t = math.pi * (d / r + 1)
        return sum(((-1) ** k * a * F.cos(k * t) for k, a in enumerate(coefficients)), F.lit(0.0))

    return f


def _sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-15, F.lit(1.0)).otherwise(F.sin(math.pi * x) / (math.pi * x))


def _parzen(d: Column, r: Column, arg) -> Column:
    """Piecewise cubic; ``arg`` is a sampling step that widens the support 2 r, and with it the bend
    at its half."""
    q, support = d / r, r + F.lit(float(arg or 0.0) / 2)
    return F.when(d <= support / 2, 1 - 6 * q * q * (1 - q)).when(d <= support, 2 * F.pow(1 - q, F.lit(3.0))).otherwise(0.0)


def _inside(f):
    return lambda d, r, arg: F.when(d <= r, f(d, r, arg)).otherwise(0.0)


#: Window functions of (distance, radius, argument), with their supports; the coefficients are those of the published windows (fixed values)
WINDOWS = {
    "boxcar": _inside(lambda d, r, a: F.lit(1.0)),
    "hamming": _inside(_cosines((0.53836, 0.46164))),
    "blackman": _inside(_cosines((7938 / 18608, 9240 / 18608, 1430 / 18608))),
    "blackman_harris": _inside(_cosines((0.35875, 0.48829, 0.14128, 0.01168))),
    "nuttall": _inside(_cosines((0.3635819, 0.4891775, 0.1365995, 0.0106411))),
    "flat_top": _inside(_cosines((0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368))),
    "gaussian": _inside(lambda d, r, a: F.exp(-0.5 * F.pow(d / F.lit(float(a)), F.lit(2.0)))),
    "lanczos": lambda d, r, a: F.when(d <= r * float(a), _sinc(d / r) * _sinc(d / (r * float(a)))).otherwise(0.0),  # a lobes of width r
    "parzen": _parzen,
    "parzen_swot": lambda d, r, a: _parzen(d, r, None),
}


def window_mean(neighbours: DataFrame, kind: str = "blackman", radius: float | None = None, arg: float | None = None, qid: str = "qid") -> DataFrame:
    """(qid, value, neighbours): mean weighted by a window of the distance; without a radius the
    farthest neighbour's distance counts as such. NULL and no neighbours where the weights add up to 0."""
    if kind not in WINDOWS:
        raise ValueError(f"no window {kind!r}")
    if kind in ("gaussian", "lanczos") and not arg:
        raise ValueError(f"{kind} needs an argument")
    r = F.lit(float(radius)) if radius else F.max("distance").over(Window.partitionBy(qid))
    rows = neighbours.withColumn("r", r)
    rows = rows.withColumn("w", WINDOWS[kind](F.col("distance"), F.greatest("r", F.lit(1e-300)), arg))
    total = F.sum("w")
    return rows.groupBy(qid).agg((F.sum(F.col("w") * F.col("value")) / F.nullif(total, F.lit(0.0))).alias("value"), F.when(total != 0, F.count("*")).otherwise(0).alias("neighbours"))


#: Radial basis functions of (r, epsilon)
RBF = {
    "cubic": lambda r, e: r**3,
    "gaussian": lambda r, e: np.exp(-((e * r) ** 2)),
    "inverse_multiquadric": lambda r, e: 1 / np.sqrt(1 + (e * r) ** 2),
    "linear": lambda r, e: r,
    "multiquadric": lambda r, e: np.sqrt(1 + (e * r) ** 2),
    "thin_plate": lambda r, e: np.where(r > 1e-15, r * r * np.log(np.maximum(r, 1e-300)), 0.0),
}

#: Covariances of (r / lambda)
COVARIANCE = {
    "matern_12": lambda q: np.exp(-q),
    "matern_32": lambda q: (1 + math.sqrt(3) * q) * np.exp(-math.sqrt(3) * q),
    "matern_52": lambda q: (1 + math.sqrt(5) * q + 5 / 3 * q * q) * np.exp(-math.sqrt(5) * q),
    "cauchy": lambda q: 1 / (1 + q * q),
    "spherical": lambda q: np.where(q < 1, 1 - 1.5 * q + 0.5 * q**3, 0.0),
    "gaussian": lambda q: np.exp(-q * q),
    "wendland": lambda q: np.where(q < 1, (1 - q) ** 2, 0.0),  # of smoothness 0 in three dimensions
}


def _solved(neighbours: DataFrame, queries: DataFrame, dims: list[str], qid: str, solve, extra: list[str] = (), schema: str = "value double", own: list[str] = ()) -> DataFrame:
    """Collects the bounded neighbours of a query and runs ``solve(p (n,k,d), v (n,k), e, q (n,d))``
    on all queries of a batch that have the same number."""
    lists = neighbours.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("distance", *[F.col(d) for d in dims], "value", *extra))).alias("s"))
    rows = queries.select(qid, *dims, *own).join(lists, qid, "left")
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(size: pd.Series, s: pd.Series, *q: pd.Series) -> pd.DataFrame:
        out = np.full((len(s), len(names)), np.nan)
        sizes = size.fillna(0).astype(int).to_numpy()
        at_q = np.stack([c.to_numpy(float) for c in q], 1)
        for k in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == k)
            a = np.array([np.asarray(s.iloc[i], float) for i in at]).reshape(len(at), k, -1)
            nd = len(dims)
            got = solve(a[:, :, :nd], a[:, :, nd], a[:, :, nd + 1 :], at_q[at, :nd], *at_q[at, nd:].T)
            out[at] = np.stack(got, 1) if isinstance(got, tuple) else np.asarray(got)[:, None]
        return pd.DataFrame({n: pd.Series(out[:, j]).astype(object).where(np.isfinite(out[:, j]), None) for j, n in enumerate(names)})

    flat = F.transform("s", lambda x: F.array(*[x[d].cast("double") for d in dims], x["value"].cast("double"), *[x[e].cast("double") for e in extra]))
    rows = rows.select(qid, *dims, *own, F.size("s").alias("k"), F.flatten(flat).alias("f"))
    out = rows.withColumn("r", F.when(F.col("f").isNotNull(), run(F.col("k"), F.col("f"), *dims, *own)))
    return out.select(qid, *[F.col(f"r.{n}").alias(n) for n in names], F.when(F.col("f").isNotNull(), F.col("k")).otherwise(0).cast("long").alias("neighbours"))


def _safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many small systems; rows of NaN where one is singular."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.full(b.shape, np.nan)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                pass
        return out


def _between(p: np.ndarray) -> np.ndarray:
    return np.sqrt(((p[:, :, None] - p[:, None]) ** 2).sum(3))


def radial_basis(neighbours: DataFrame, queries: DataFrame, dims: list[str], kind: str = "multiquadric", epsilon: float | None = None, smooth: float = 0.0, qid: str = "qid") -> DataFrame:
    """(qid, value, neighbours). Distances are divided by ``epsilon``; without one, by the mean distance
    of the neighbours."""
    f = RBF[kind]

    def solve(p, v, _, q):
        d = _between(p)
        k = p.shape[1]
        mean = d.sum((1, 2)) / max(k * (k - 1), 1)
        e = (1 / np.where(mean > 0, mean, 1) if epsilon is None else np.full(len(p), 1 / float(epsilon)))[:, None, None]
        w = _safe(f(d, e) + smooth * np.eye(k), v)
        return (f(np.sqrt(((p - q[:, None]) ** 2).sum(2)), e[:, 0]) * w).sum(1)

    return _solved(neighbours, queries, dims, qid, solve)


def kriging(neighbours: DataFrame, queries: DataFrame, dims: list[str], covariance: str = "spherical", sigma: float = 1.0, length: float = 1.0, nugget: float = 0.0, drift: str | None = None, qid: str = "qid") -> DataFrame:
    """(qid, value, neighbours): simple kriging of zero mean, or universal with ``drift`` linear or
    quadratic. NULL where there are fewer neighbours than drift terms. Neighbours on one plane, line or
    place leave terms of the drift open: the system then has no inverse and is solved by least squares in
    the units of ``dims``, as the reference's rank-revealing QR does. The weights of that are unique if the
    covariance of the neighbours is positive definite."""
    if not (sigma > 0 and length > 0 and nugget >= 0):
        raise ValueError("sigma and length are positive, nugget is not negative")
    cov = lambda d: sigma * sigma * COVARIANCE[covariance](d / length)

    def terms(p):
        out = [np.ones(p.shape[:-1]), *[p[..., i] for i in range(p.shape[-1])]]
        if drift == "quadratic":
            out += [p[..., i] * p[..., j] for i in range(p.shape[-1]) for j in range(i, p.shape[-1])]
        return np.stack(out, -1)

    def saddle(c, f):
        k, m = f.shape[1:]
        a = np.zeros((len(c), k + m, k + m))
        a[:, :k, :k], a[:, :k, k:], a[:, k:, :k] = c, f, f.transpose(0, 2, 1)
        return a

    def solve(p, v, _, q):
        k = p.shape[1]
        c = cov(_between(p)) + nugget * np.eye(k)
        c0 = cov(np.sqrt(((p - q[:, None]) ** 2).sum(2)))
        if drift is None:
            return (_safe(c, c0) * v).sum(1)
        centre = p.mean(1, keepdims=True)
        scale = np.maximum(np.abs(p - centre).max((1, 2)), 1e-300)[:, None, None]
        f, f0 = terms((p - centre) / scale), terms((q[:, None] - centre) / scale)[:, 0]
        m = f.shape[2]
        if k < m:
            return np.full(len(p), np.nan)
        w, known = np.full((len(p), k), np.nan), np.isfinite(p).all((1, 2)) & np.isfinite(q).all(1)
        s = np.linalg.svd(np.where(known[:, None, None], f, 0.0), compute_uv=False)
        noise = np.finfo(float).eps * np.abs(p).max((1, 2)) / scale[:, 0, 0]  # of a place, beside their spread
        flat = known & (s[:, -1] <= s[:, 0] * np.maximum(1e-10, 64 * noise))
        clear = known & ~flat
        w[clear] = _safe(saddle(c[clear], f[clear]), np.concatenate([c0, f0], 1)[clear])[:, :k]
        if flat.any():
            inverse = np.linalg.pinv(saddle(c[flat], terms(p[flat])), rcond=1e-12, hermitian=True)
            w[flat] = (inverse @ np.concatenate([c0[flat], terms(q[flat])], 1)[..., None])[:, :k, 0]
        return (w * v).sum(1)

    return _solved(neighbours, queries, dims, qid, solve)


def optimal_interpolation(neighbours: DataFrame, queries: DataFrame, dims: list[str], scales: list[float | str], sigma: float = 1.0, covariance: str = "gaussian", error: str = "sigma2", qid: str = "qid") -> DataFrame:
    """(qid, value, std, neighbours): simple kriging with one length scale for each coordinate and
    an error variance for each observation (column ``error``). A scale is a number, or the name of
    a column of ``queries`` (for instance sampled from a grid by ``grid.interpolate``)."""
    if not (sigma > 0 and all(isinstance(s, str) or (s > 0 and math.isfinite(s)) for s in scales)):
        raise ValueError("scales and sigma are positive and finite")
    cov, named = COVARIANCE[covariance], [s for s in scales if isinstance(s, str)]
    for c in named:
        bad = F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0)
        queries = queries.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} must be positive and finite"))).otherwise(F.col(c)).cast("double"))

    def solve(p, v, e, q, *own):
        k, own = p.shape[1], list(own)
        s = np.stack([own.pop(0) if isinstance(x, str) else np.full(len(p), float(x)) for x in scales], 1)[:, None]
        c = sigma * sigma * cov(_between(p / s)) + e[:, :, 0, None] * np.eye(k)
        c0 = sigma * sigma * cov(np.sqrt((((p - q[:, None]) / s) ** 2).sum(2)))
        w = _safe(c, c0)
        return (w * v).sum(1), np.sqrt(np.maximum(sigma * sigma - (w * c0).sum(1), 0))

    return _solved(neighbours, queries, dims, qid, solve, [error], "value double, std double", named)
