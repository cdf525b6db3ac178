"""Geodesics on the spheroid to full precision, by the series of Karney (2013), and their areas.

A geodesic is followed on the auxiliary sphere from where it crosses the equator. Distance, reduced
length and longitude are trigonometric series in the arc, of the sixth order in the expansion
parameter. The inverse problem looks for the azimuth at the first point whose geodesic meets the
second latitude at the right longitude: Newton's method, kept inside a bracket that always holds the
one root, so that it also converges between points that are almost opposite. The area between a
geodesic and the equator is a smooth integral over the arc, taken by Gauss's rule.

All functions work on numpy arrays of degrees and metres; ``inverse`` and ``measures`` wrap them for
columns. Missing values and values that are no latitudes (beyond 90 degrees) give missing results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import WGS84, Spheroid

# Coefficients of the published series: of each term, (power of eps, value) in turn.
# Fixed values.
A1 = ((0, 1), (2, 1 / 4), (4, 1 / 64), (6, 1 / 256))
C1 = (
    ((1, -1 / 2), (3, 3 / 16), (5, -1 / 32)),
    ((2, -1 / 16), (4, 1 / 32), (6, -9 / 2048)),
    ((3, -1 / 48), (5, 3 / 256)),
    ((4, -5 / 512), (6, 3 / 512)),
    ((5, -7 / 1280),),
    ((6, -7 / 2048),),
)
A2 = ((0, 1), (2, 1 / 4), (4, 9 / 64), (6, 25 / 256))
C2 = (
    ((1, 1 / 2), (3, 1 / 16), (5, 1 / 32)),
    ((2, 3 / 16), (4, 1 / 32), (6, 35 / 2048)),
    ((3, 5 / 48), (5, 5 / 256)),
    ((4, 35 / 512), (6, 7 / 512)),
    ((5, 63 / 1280),),
    ((6, 77 / 2048),),
)


def _third(n: float) -> tuple:
    """A3 and C3, whose coefficients depend on the third flattening. Fixed values."""
    a3 = ((0, 1), (1, -(1 - n) / 2), (2, -(2 + n - 3 * n * n) / 8), (3, -(1 + 3 * n + n * n) / 16), (4, -(3 + 2 * n) / 64), (5, -3 / 128))
    c3 = (
        ((1, (1 - n) / 4), (2, (1 - n * n) / 8), (3, (3 + 3 * n - n * n) / 64), (4, (5 + 2 * n) / 128), (5, 3 / 128)),
        ((2, (2 - 3 * n + n * n) / 32), (3, (3 - 2 * n - 3 * n * n) / 64), (4, (3 + n) / 128), (5, 5 / 256)),
        ((3, (5 - 9 * n + 5 * n * n) / 192), (4, (9 - 10 * n) / 384), (5, 7 / 512)),
        ((4, (7 - 14 * n) / 512), (5, 7 / 512)),
        ((5, 21 / 2560),),
    )
    return a3, c3


def _poly(terms, e):
    return sum(c * e**p for p, c in terms)


def _sines(series, e, s, c):
    """Sum of terms times sin(2 j sigma), by Clenshaw's rule; s, c: sine and cosine of sigma."""
    two = 2 * (c - s) * (c + s)
    up = upper = 0.0
    for terms in reversed(series):
        up, upper = _poly(terms, e) + two * up - upper, up
    return 2 * s * c * up


def _unit(s, c):
    h = np.hypot(s, c)
    return s / h, c / h


class _Line:
    """Geodesics by the sine and cosine of their azimuth at a reduced latitude (sb1, cb1)."""

    def __init__(self, e: Spheroid, sb1, cb1, sa1, ca1):
        self.e = e
        self.s0, self.c0 = sa1 * cb1, np.hypot(ca1, sa1 * sb1)
        k2 = e.ep2 * self.c0**2
        root = np.sqrt(1 + k2)
        self.k2, self.eps = k2, k2 / (2 * (1 + root) + k2)

    def arc(self, sb, ca_cb):
        """Sine and cosine of sigma, and of omega, where the latitude's sine is sb."""
        ss, cs = _unit(sb, ca_cb)
        so, co = _unit(self.s0 * sb, ca_cb)
        return ss, cs, so, co

    def first(self, ss, cs, sigma):
        return _poly(A1, self.eps) / (1 - self.eps) * (sigma + _sines(C1, self.eps, ss, cs))

    def second(self, ss, cs, sigma):
        return _poly(A2, self.eps) * (1 - self.eps) * (sigma + _sines(C2, self.eps, ss, cs))

    def third(self, ss, cs, sigma):
        a3, c3 = _third(self.e.f / (2 - self.e.f))
        return _poly(a3, self.eps) * (sigma + _sines(c3, self.eps, ss, cs))


def _reach(e: Spheroid, sb1, cb1, sb2, cb2, sa1, ca1):
    """The longitude at which the geodesic meets the second latitude going up, its derivative by the
    azimuth, the distance, and the azimuth there."""
    line = _Line(e, sb1, cb1, sa1, ca1)
    sa2 = line.s0 / cb2
    # cos(a2) cos(b2), from what is left of the first one's, without loss near the poles
    part = np.where(cb1 < -sb1, (cb2 - cb1) * (cb1 + cb2), (sb1 - sb2) * (sb1 + sb2))
    ca2cb2 = np.sqrt(np.maximum((ca1 * cb1) ** 2 + part, 0))
    same = (cb2 == cb1) & (np.abs(sb2) == -sb1)
    ca2 = np.where(same, np.abs(ca1), ca2cb2 / cb2)
    ss1, cs1, so1, co1 = line.arc(sb1, ca1 * cb1)
    ss2, cs2, so2, co2 = line.arc(sb2, ca2 * cb2)
    sig1, sig2 = np.arctan2(ss1, cs1), np.arctan2(ss2, cs2)
    sig12 = np.arctan2(np.maximum(cs1 * ss2 - ss1 * cs2, 0), cs1 * cs2 + ss1 * ss2)
    om12 = np.arctan2(np.maximum(co1 * so2 - so1 * co2, 0), co1 * co2 + so1 * so2)
    # series by the difference of arcs, as sig12 is exact where both are close
    diff = lambda f: f(ss2, cs2, sig1 + sig12) - f(ss1, cs1, sig1)
    lam = om12 - e.f * line.s0 * diff(line.third)
    i1, i2 = diff(line.first), diff(line.second)
    r1, r2 = np.sqrt(1 + line.k2 * ss1**2), np.sqrt(1 + line.k2 * ss2**2)
    m = r2 * (cs1 * ss2) - r1 * (ss1 * cs2) - cs1 * cs2 * (i1 - i2)
    with np.errstate(all="ignore"):
        slope = np.where(np.abs(ca2) > 0, m * e.b / (e.a * ca2 * cb2), -2 * e.b / e.a * r1 / sb1)
    return lam, slope, e.b * i1, sa2, ca2, (line, sig1, sig12, sig2)


def inverse_arrays(lon1, lat1, lon2, lat2, e: Spheroid = WGS84, area: bool = False):
    """Distance in metres and azimuths at both ends in degrees clockwise from north (-180 to 180); with
    ``area`` also the area between the geodesic and the equator, positive for the east."""
    lon1, lat1, lon2, lat2 = (np.asarray(v, float) for v in np.broadcast_arrays(lon1, lat1, lon2, lat2))
    bad = ~(np.isfinite(lon1) & np.isfinite(lon2) & (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90))
    x1, x2, y1, y2 = (np.where(bad, 0.0, v) for v in (lon1, lon2, lat1, lat2))
    dlon = np.remainder(x2 - x1 + 180, 360) - 180
    dlon = np.where((dlon == -180) & (x2 > x1), 180.0, dlon)
    # both points so that the first is the farther from the equator and south, going east
    east = np.where(dlon < 0, -1.0, 1.0)
    lam = np.radians(np.abs(dlon))
    swap = np.abs(y1) < np.abs(y2)
    y1, y2 = np.where(swap, y2, y1), np.where(swap, y1, y2)
    north = np.where(y1 > 0, -1.0, 1.0)
    y1, y2 = y1 * north, y2 * north

    def reduced(y):
        s, c = _unit((1 - e.f) * np.sin(np.radians(y)), np.cos(np.radians(y)))
        return s, np.where(np.abs(y) == 90, 1e-200, c)

    (sb1, cb1), (sb2, cb2) = reduced(y1), reduced(y2)
    cb2 = np.where(np.abs(y1) == np.abs(y2), cb1, cb2)
    sb2 = np.where(np.abs(y1) == np.abs(y2), np.copysign(sb1, sb2), sb2)
    slam, clam = np.where(np.abs(dlon) == 180, 0.0, np.sin(lam)), np.cos(lam)
    straight = (y1 == -90) | (slam == 0)  # along a meridian, if that is shortest
    flat = (sb1 == 0) & (lam <= (1 - e.f) * np.pi)  # along the equator
    with np.errstate(all="ignore"):
        # along the meridian: over the south pole's side or on to the north, at azimuth 0 or pi
        mca = np.where(clam > 0, 1.0, -1.0)
        _, _, md, msa, mca2, mparts = _reach(e, sb1, cb1, sb2, cb2, np.zeros_like(lam), np.where(y1 == -90, clam, mca))
        line = _Line(e, sb1, cb1, np.zeros_like(lam), mca)
        s1, c1 = _unit(sb1, mca * cb1)
        s2, c2 = _unit(sb2, cb2)
        arc = np.arctan2(np.maximum(c1 * s2 - s1 * c2, 0), c1 * c2 + s1 * s2)
        sig1 = np.arctan2(s1, c1)
        i1 = line.first(s2, c2, sig1 + arc) - line.first(s1, c1, sig1)
        i2 = line.second(s2, c2, sig1 + arc) - line.second(s1, c1, sig1)
        k = np.sqrt(1 + line.k2)
        m = np.sqrt(1 + line.k2 * s2**2) * c1 * s2 - np.sqrt(1 + line.k2 * s1**2) * s1 * c2 - c1 * c2 * (i1 - i2)
        meridian = straight & ((arc < 1) | (m >= 0)) & np.isfinite(k)
        # elsewhere: safeguarded Newton from the great circle's azimuth
        low, high = np.full_like(lam, 1e-15), np.full_like(lam, np.pi - 1e-15)
        w = lam / np.sqrt(1 - e.e2 * ((cb1 + cb2) / 2) ** 2)
        w = np.where(w > np.pi, lam, w)
        a = np.arctan2(cb2 * np.sin(w), np.where(np.cos(w) >= 0, sb2 * cb1 - cb2 * sb1 * np.cos(w), sb2 * cb1 - cb2 * sb1 * np.cos(w)))
        a = np.clip(np.where(np.isfinite(a), a, np.pi / 2), low, high)
        done = meridian | flat | ((lam == 0) & (y1 == y2))
        for turn in range(120):
            got, slope, *_ = _reach(e, sb1, cb1, sb2, cb2, np.sin(a), np.cos(a))
            v = got - lam
            high, low = np.where(v > 0, a, high), np.where(v < 0, a, low)
            new = a - v / slope
            new = np.where((new > low) & (new < high) & (slope > 0) & np.isfinite(new) & (turn % 12 < 10), new, (low + high) / 2)
            done = done | (np.abs(v) < 3e-16) | (high - low < 1e-16) | (np.abs(new - a) < 1e-16 * np.abs(a))
            if done.all():
                break
            a = np.where(done, a, new)
        sa1, ca1 = np.sin(a), np.cos(a)
        _, _, d, sa2, ca2, parts = _reach(e, sb1, cb1, sb2, cb2, sa1, ca1)
        d = np.where(meridian, e.b * i1, np.where(flat, e.a * lam, d))
        sa1, ca1 = np.where(meridian, np.where(y1 == -90, slam, 0.0), np.where(flat, 1.0, sa1)), np.where(meridian, np.where(y1 == -90, clam, mca), np.where(flat, 0.0, ca1))
        sa2, ca2 = np.where(meridian, 0.0, np.where(flat, 1.0, sa2)), np.where(meridian, 1.0, np.where(flat, 0.0, ca2))
        sa2 = np.where(meridian & (y1 == -90), 0.0, sa2)
    same = (lam == 0) & (y1 == y2)
    d = np.where(same, 0.0, d)
    sa1, ca1, sa2, ca2 = np.where(same, 0.0, sa1), np.where(same, 1.0, ca1), np.where(same, 0.0, sa2), np.where(same, 1.0, ca2)
    # back to the given order
    f1s, f1c = np.where(swap, sa2, sa1), np.where(swap, ca2, ca1)
    f2s, f2c = np.where(swap, sa1, sa2), np.where(swap, ca1, ca2)
    flip = np.where(swap, -1.0, 1.0)
    az1 = np.degrees(np.arctan2(f1s * flip * flip * east, f1c * north * flip))
    az2 = np.degrees(np.arctan2(f2s * flip * flip * east, f2c * north * flip))
    gone = lambda v: np.where(bad, np.nan, v)
    if not area:
        return gone(d), gone(az1), gone(az2)
    below = _below(e, sb1, cb1, sb2, cb2, sa1, ca1, sa2, ca2, flat | same)
    return gone(d), gone(az1), gone(az2), gone(below * east * north)


_X, _W = np.polynomial.legendre.leggauss(24)


def _below(e: Spheroid, sb1, cb1, sb2, cb2, sa1, ca1, sa2, ca2, nothing):
    """The area between the geodesic and the equator, positive north of it and going east: a part from
    the turn of the azimuth, which is the sphere's, and one from the flattening."""
    s0, c0 = sa1 * cb1, np.hypot(ca1, sa1 * sb1)
    k2 = e.ep2 * c0**2
    with np.errstate(all="ignore"):
        t = lambda x: np.where(x > 0, x + np.sqrt(1 / np.where(x > 0, x, 1) + 1) * np.arcsinh(np.sqrt(np.maximum(x, 0))), 1.0)
        sig1 = np.arctan2(sb1, ca1 * cb1)
        sig2 = np.arctan2(sb2, ca2 * cb2)
        sig2 = np.where(sig2 < sig1, sig2 + 2 * np.pi, sig2)
        mid, half = (sig1 + sig2) / 2, (sig2 - sig1) / 2
        s = np.sin(mid[..., None] + half[..., None] * _X)
        x = k2[..., None] * s * s
        inner = (t(np.full_like(x, e.ep2)) - t(x)) / (e.ep2 - x) * s / 2
        integral = -(inner * _W).sum(-1) * half
        integral = np.where(np.isfinite(integral), integral, 0.0)  # at a pole the factor before it is 0
        az = np.arctan2(sa2 * ca1 - ca2 * sa1, ca2 * ca1 + sa2 * sa1)
        c2 = e.authalic_radius**2
        return np.where(nothing, 0.0, c2 * az + e.e2 * e.a**2 * s0 * c0 * integral)


def inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column, spheroid: Spheroid = WGS84) -> Column:
    """struct(distance, azimuth1, azimuth2): metres, and degrees clockwise from north."""

    @F.pandas_udf("struct<distance:double,azimuth1:double,azimuth2:double>")
    def run(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        d, p, q = inverse_arrays(*(v.to_numpy(float) for v in (x1, y1, x2, y2)), spheroid)
        return pd.DataFrame({"distance": d, "azimuth1": p, "azimuth2": q})

    given = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull() & F.abs(lat1).between(0, 90) & F.abs(lat2).between(0, 90)
    return F.when(given, run(*[c.cast("double") for c in (lon1, lat1, lon2, lat2)]))


def measures(points: Column, sizes: Column, spheroid: Spheroid = WGS84) -> Column:
    """struct(length, areas) of lists of points (x, y: degrees), one after the other in ``points``, of
    ``sizes`` points each: metres along all of them, and of each closed list the square metres on its
    left (negative if its right is the smaller side). NULL where a coordinate is missing."""
    whole = 4 * math.pi * spheroid.authalic_radius**2

    @F.pandas_udf("struct<length:double,areas:array<double>>")
    def run(xs: pd.Series, ys: pd.Series, ns: pd.Series) -> pd.DataFrame:
        there = [x is not None and n is not None and all(v is not None for v in n) for x, n in zip(xs, ns, strict=True)]  # others are NULL in the end
        xs, ys, ns = ([v if ok else () for v, ok in zip(c, there, strict=True)] for c in (xs, ys, ns))
        flat = lambda col, kind: np.concatenate([np.asarray(v, kind) for v in col]) if len(col) else np.zeros(0, kind)
        x, y, n = flat(xs, float), flat(ys, float), flat(ns, int)
        lists = np.array([len(v) for v in ns], int)
        owner, row = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(lists)), lists)
        step = owner[1:] == owner[:-1]
        a, b, at = x[:-1][step], x[1:][step], owner[1:][step]
        d, _, _, below = inverse_arrays(a, y[:-1][step], b, y[1:][step], spheroid, True)
        turns = np.bincount(at, np.remainder(b - a + 180, 360) - 180, len(n))
        area = -np.bincount(at, below, len(n))
        # around a pole: a half of the whole, less what is between the list and the equator
        area = np.where(np.abs(turns) > 180, np.where(turns > 0, whole / 2, -whole / 2) + area, area)
        area = np.where(area > whole / 2, area - whole, np.where(area < -whole / 2, area + whole, area))
        length = np.bincount(row[at] if len(at) else at, d, len(lists))
        return pd.DataFrame({"length": length, "areas": pd.Series(np.split(area, np.cumsum(lists)[:-1]) if len(lists) else [], dtype=object)})

    x, y = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    there = F.forall(points, lambda p: F.coalesce(F.abs(p["y"]) <= 90, F.lit(False)) & p["x"].isNotNull())
    return F.when(points.isNotNull() & there, run(x, y, sizes))
