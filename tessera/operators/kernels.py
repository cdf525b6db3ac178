"""Batched one-dimensional interpolation in numpy: rows of nodes xs (n, m), values ys (n, m)."""

from __future__ import annotations

import numpy as np

MINIMUM = {"linear": 2, "polynomial": 3, "c_spline": 4, "c_spline_not_a_knot": 4, "c_spline_periodic": 4, "akima": 5, "akima_periodic": 5, "steffen": 3}


def _cell(xs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The interval of each x, and -1 outside; nodes ascend."""
    i = np.clip((xs <= x[:, None]).sum(1) - 1, 0, xs.shape[1] - 2)
    return np.where((x >= xs[:, 0]) & (x <= xs[:, -1]), i, -1)


def _moments(xs: np.ndarray, ys: np.ndarray, kind: str) -> np.ndarray:
    """Second derivatives at the nodes of the cubic spline."""
    n, m = xs.shape
    h, s = np.diff(xs), np.diff(ys) / np.diff(xs)
    a, r = np.zeros((n, m, m)), np.zeros((n, m))
    k = np.arange(1, m - 1)
    a[:, k, k - 1], a[:, k, k], a[:, k, k + 1] = h[:, :-1], 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:]
    r[:, k] = 6 * np.diff(s)
    if kind == "c_spline":
        a[:, 0, 0] = a[:, -1, -1] = 1
    elif kind == "c_spline_not_a_knot":
        a[:, 0, 0], a[:, 0, 1], a[:, 0, 2] = h[:, 1], -(h[:, 0] + h[:, 1]), h[:, 0]
        a[:, -1, -1], a[:, -1, -2], a[:, -1, -3] = h[:, -2], -(h[:, -1] + h[:, -2]), h[:, -1]
    else:  # periodic: equal first and second derivatives at the ends
        a[:, 0, 0], a[:, 0, -1] = 1, -1
        a[:, -1, 0], a[:, -1, 1] = 2 * h[:, 0], h[:, 0]
        a[:, -1, -2], a[:, -1, -1] = h[:, -1], 2 * h[:, -1]
        r[:, -1] = 6 * (s[:, 0] - s[:, -1])
    return np.linalg.solve(a, r[..., None])[..., 0]


def _slopes(xs: np.ndarray, ys: np.ndarray, kind: str) -> np.ndarray:
    """First derivatives at the nodes, of the Hermite methods."""
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    n, m = xs.shape
    if kind == "steffen":
        s = np.zeros((n, m))
        p = (d[:, :-1] * h[:, 1:] + d[:, 1:] * h[:, :-1]) / (h[:, :-1] + h[:, 1:])
        s[:, 1:-1] = (np.sign(d[:, :-1]) + np.sign(d[:, 1:])) * np.minimum(np.minimum(np.abs(d[:, :-1]), np.abs(d[:, 1:])), 0.5 * np.abs(p))
        s[:, 0], s[:, -1] = d[:, 0], d[:, -1]
        return s
    if kind == "akima_periodic":
        e = np.concatenate([d[:, -2:], d, d[:, :2]], 1)
        a, b = np.abs(e[:, 3:] - e[:, 2:-1]), np.abs(e[:, 1:-2] - e[:, :-3])
        left, right = e[:, 1:-2], e[:, 2:-1]
        return np.where(a + b > 0, (a * left + b * right) / np.where(a + b > 0, a + b, 1), (left + right) / 2)
    s = np.empty((n, m))
    a, b = np.abs(d[:, 3:] - d[:, 2:-1]), np.abs(d[:, 1:-2] - d[:, :-3])
    left, right = d[:, 1:-2], d[:, 2:-1]
    s[:, 2:-2] = np.where(a + b > 0, (a * left + b * right) / np.where(a + b > 0, a + b, 1), (left + right) / 2)
    s[:, 0], s[:, -1] = d[:, 0], d[:, -1]
    s[:, 1], s[:, -2] = (d[:, 0] + d[:, 1]) / 2, (d[:, -2] + d[:, -1]) / 2
    return s


def univariate(xs: np.ndarray, ys: np.ndarray, x: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Value and first derivative at x; NaN outside the nodes, where a value is missing, where two
    nodes are equal, or where the method has too few nodes."""
    n, m = xs.shape
    value, slope = np.full(n, np.nan), np.full(n, np.nan)
    flip = xs[:, 0] > xs[:, -1]
    xs, ys = np.where(flip[:, None], xs[:, ::-1], xs), np.where(flip[:, None], ys[:, ::-1], ys)
    i = _cell(xs, x)
    ok = (i >= 0) & np.isfinite(ys).all(1) & (np.diff(xs) > 0).all(1)
    if m < MINIMUM[method] or not ok.any():
        return value, slope
    xs, ys, x, i = xs[ok], ys[ok], x[ok], i[ok]
    r = np.arange(len(x))
    if method == "polynomial":  # Newton's divided differences
        c = ys.copy()
        for k in range(1, m):
            c[:, k:] = (c[:, k:] - c[:, k - 1 : -1]) / (xs[:, k:] - xs[:, :-k])
        v, d = c[:, -1].copy(), np.zeros(len(x))
        for k in range(m - 2, -1, -1):
            d = d * (x - xs[:, k]) + v
            v = v * (x - xs[:, k]) + c[:, k]
    else:
        x0, x1, y0, y1 = xs[r, i], xs[r, i + 1], ys[r, i], ys[r, i + 1]
        h, t = x1 - x0, x - x0
        if method == "linear":
            d = (y1 - y0) / h
            v = y0 + d * t
        elif method.startswith("c_spline"):
            mo = _moments(xs, ys, method)
            m0, m1 = mo[r, i], mo[r, i + 1]
            b = (y1 - y0) / h - h * (2 * m0 + m1) / 6
            v = y0 + t * (b + t * (m0 / 2 + t * (m1 - m0) / (6 * h)))
            d = b + t * (m0 + t * (m1 - m0) / (2 * h))
        else:
            s = _slopes(xs, ys, method)
            s0, s1, e = s[r, i], s[r, i + 1], (y1 - y0) / h
            c2, c3 = (3 * e - 2 * s0 - s1) / h, (s0 + s1 - 2 * e) / (h * h)
            v = y0 + t * (s0 + t * (c2 + t * c3))
            d = s0 + t * (2 * c2 + 3 * t * c3)
    value[ok], slope[ok] = v, d
    return value, slope


def bivariate(xs: np.ndarray, ys: np.ndarray, z: np.ndarray, x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """z: (n, mx, my). Along y for each x, then along x. The bicubic surface with derivatives from
    splines is the product of cubic splines, so it is the same as ``c_spline``."""
    method = {"bicubic": "c_spline", "bilinear": "linear"}.get(method, method)
    n, mx, my = z.shape
    if np.isnan(z).all():
        return np.full(n, np.nan)
    bad = np.isnan(z).any((1, 2))
    rows = univariate(np.repeat(ys, mx, 0), z.reshape(n * mx, my), np.repeat(y, mx), method)[0].reshape(n, mx)
    return np.where(bad, np.nan, univariate(xs, rows, x, method)[0])
