"""Spheroids, geocentric coordinates and geodesic measures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .let import let


@dataclass(frozen=True)
class Spheroid:
    """Defaults: WGS 84."""

    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    semi_minor_axis = b

    @property
    def e2(self) -> float:
        """First eccentricity squared."""
        return self.f * (2 - self.f)

    @property
    def ep2(self) -> float:
        """Second eccentricity squared."""
        return self.e2 / (1 - self.e2)

    @property
    def equatorial_circumference(self) -> float:
        return 2 * math.pi * self.a

    @property
    def polar_radius_of_curvature(self) -> float:
        return self.a * self.a / self.b

    @property
    def equatorial_radius_of_curvature(self) -> float:
        return self.b * self.b / self.a

    @property
    def axis_ratio(self) -> float:
        return self.b / self.a

    @property
    def linear_eccentricity(self) -> float:
        return math.sqrt(self.a**2 - self.b**2)

    @property
    def mean_radius(self) -> float:
        return (2 * self.a + self.b) / 3

    @property
    def authalic_radius(self) -> float:
        e = math.sqrt(self.e2)
        return math.sqrt((self.a**2 + self.b**2 * math.atanh(e) / e) / 2) if e else self.a

    @property
    def volumetric_radius(self) -> float:
        return (self.a**2 * self.b) ** (1 / 3)

    def geocentric_radius(self, lat: Column) -> Column:
        c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
        p, q = self.a * c, self.b * s
        return F.sqrt((self.a * self.a * c * self.a * self.a * c + self.b * self.b * s * self.b * self.b * s) / (p * p + q * q))

    # geocentric coordinates
    def lla_to_ecef(self, lon: Column, lat: Column, alt: Column | None = None) -> Column:
        h = F.lit(0.0) if alt is None else alt
        s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
        n = F.lit(self.a) / F.sqrt(1 - self.e2 * s * s)
        return F.struct(((n + h) * c * F.cos(F.radians(lon))).alias("x"), ((n + h) * c * F.sin(F.radians(lon))).alias("y"), ((n * (1 - self.e2) + h) * s).alias("z"))

    def ecef_to_lla(self, x: Column, y: Column, z: Column) -> Column:
        """Vermeille's closed form of 2002, for points that are not near the centre."""
        a2, e2 = self.a * self.a, self.e2
        e4 = e2 * e2
        start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), ((x * x + y * y) / a2).alias("p"), ((1 - e2) / a2 * z * z).alias("q"))

        def one(i: Column) -> Column:
            r = (i["p"] + i["q"] - e4) / 6
            s = e4 * i["p"] * i["q"] / (4 * r * r * r)
            return F.struct(i.alias("i"), r.alias("r"), F.cbrt(1 + s + F.sqrt(s * (2 + s))).alias("t"))

        def two(j: Column) -> Column:
            u = j["r"] * (1 + j["t"] + 1 / j["t"])
            return F.struct(j["i"].alias("i"), u.alias("u"), F.sqrt(u * u + e4 * j["i"]["q"]).alias("v"))

        def three(j: Column) -> Column:
            w = e2 * (j["u"] + j["v"] - j["i"]["q"]) / (2 * j["v"])
            k = F.sqrt(j["u"] + j["v"] + w * w) - w
            return F.struct(j["i"].alias("i"), k.alias("k"), (k * F.sqrt(j["i"]["x"] * j["i"]["x"] + j["i"]["y"] * j["i"]["y"]) / (k + e2)).alias("d"))

        def four(j: Column) -> Column:
            i, d = j["i"], j["d"]
            m = F.sqrt(d * d + i["z"] * i["z"])
            return F.struct(F.degrees(F.atan2(i["y"], i["x"])).alias("lon"), F.degrees(2 * F.atan2(i["z"], d + m)).alias("lat"), ((j["k"] + e2 - 1) / j["k"] * m).alias("alt"))

        return let(let(let(let(start, one), two), three), four)

    def with_lla(self, df: DataFrame, x: str, y: str, z: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
        """``df`` with the columns lon and lat of geocentric coordinates, bit for bit those of
        ``ecef_to_lla``: each value is a column of its own, so Spark compiles them all and leaves out
        those that are not read."""
        a2, e2 = self.a * self.a, self.e2
        e4 = e2 * e2
        x, y, z, p, q, r, s, t, u, v, w, k, d, m = (F.col(c) for c in (x, y, z, *(f"__{c}" for c in "pqrstuvwkdm")))
        steps = [
            {"p": (x * x + y * y) / a2, "q": (1 - e2) / a2 * z * z},
            {"r": (p + q - e4) / 6},
            {"s": e4 * p * q / (4 * r * r * r)},
            {"t": F.cbrt(1 + s + F.sqrt(s * (2 + s)))},
            {"u": r * (1 + t + 1 / t)},
            {"v": F.sqrt(u * u + e4 * q)},
            {"w": e2 * (u + v - q) / (2 * v)},
            {"k": F.sqrt(u + v + w * w) - w},
            {"d": k * F.sqrt(x * x + y * y) / (k + e2)},
            {"m": F.sqrt(d * d + z * z)},
        ]
        for step in steps:
            df = df.withColumns({f"__{name}": c for name, c in step.items()})
        return df.withColumns({lon: F.degrees(F.atan2(y, x)), lat: F.degrees(2 * F.atan2(z, d + m))}).drop(*[f"__{c}" for c in "pqrstuvwkdm"])

    def transform(self, target: Spheroid, lon: Column, lat: Column, alt: Column) -> Column:
        p = self.lla_to_ecef(lon, lat, alt)
        return target.ecef_to_lla(p["x"], p["y"], p["z"])

    # distances in metres
    def andoyer(self, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
        """First-order correction of the great circle (Andoyer-Lambert)."""
        f, g, lam = F.radians((lat1 + lat2) / 2), F.radians((lat1 - lat2) / 2), F.radians((lon1 - lon2) / 2)
        sg, sl, cf, sf, cg, cl = F.sin(g), F.sin(lam), F.cos(f), F.sin(f), F.cos(g), F.cos(lam)
        s = sg * sg * cl * cl + cf * cf * sl * sl
        c = cg * cg * cl * cl + sf * sf * sl * sl
        w = F.atan2(F.sqrt(s), F.sqrt(c))
        r = F.sqrt(s * c) / w
        h1, h2 = (3 * r - 1) / (2 * c), (3 * r + 1) / (2 * s)
        d = 2 * w * self.a * (1 + self.f * h1 * sf * sf * cg * cg - self.f * h2 * cf * cf * sg * sg)
        return F.when(s == 0, F.lit(0.0)).when(c == 0, F.lit(math.pi * self.a)).otherwise(d)

    def thomas(self, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
        """Second-order correction of the great circle (Thomas 1970), on reduced latitudes."""
        f = self.f

        def first(i: Column) -> Column:
            t1, t2 = F.atan((1 - f) * F.tan(F.radians(i["a"]))), F.atan((1 - f) * F.tan(F.radians(i["b"])))
            m, d, half = F.sin((t1 + t2) / 2), F.sin((t2 - t1) / 2), F.sin(F.radians(i["l"]) / 2)
            s, c, k = m * m, d * d, half * half
            return F.struct(s.alias("s"), c.alias("c"), (c + (1 - s - c) * k).alias("L"))

        def second(i: Column) -> Column:
            big, s, c = i["L"], i["s"], i["c"]
            u, v = 2 * s * (1 - c) / (1 - big), 2 * c * (1 - s) / big
            d = F.acos(1 - 2 * big)
            return F.struct((u + v).alias("x"), (u - v).alias("y"), (d / F.sin(d)).alias("t"), (2 - 4 * big).alias("e"), F.sin(d).alias("sd"))

        def third(i: Column) -> Column:
            x, y, t, e = i["x"], i["y"], i["t"], i["e"]
            d4 = 4 * t * t
            n = x * (d4 * e + (t - (d4 * e - e) / 2) * x) - y * (2 * d4 + e * y) + d4 * x * y
            return self.a * i["sd"] * (t - f * (t * x - y) / 4 + f * f * n / 64)

        start = F.struct(lat1.cast("double").alias("a"), lat2.cast("double").alias("b"), (lon2 - lon1).cast("double").alias("l"))
        return let(let(start, first), lambda i: F.when(i["L"] <= 1e-24, F.lit(0.0)).otherwise(let(let(i, second), third)))

    def vincenty(self, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
        """Iterated inverse problem, to about a millimetre; near-antipodal points that do not
        converge get the distance and azimuth of the great circle on the mean radius."""
        a, f, b = self.a, self.f, self.b
        mean = self.mean_radius

        @F.pandas_udf("struct<distance:double,azimuth:double>")
        def inverse(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
            d, az = vincenty_inverse(x1.to_numpy(float), y1.to_numpy(float), x2.to_numpy(float), y2.to_numpy(float), a, f, b, mean)
            return pd.DataFrame({"distance": d, "azimuth": az})

        return inverse(lon1, lat1, lon2, lat2)


def vincenty_inverse(x1, y1, x2, y2, a, f, b, mean):
    """Distances in metres and forward azimuths in radians, for arrays of degrees."""
    with np.errstate(all="ignore"):
        u1, u2 = np.arctan((1 - f) * np.tan(np.radians(y1))), np.arctan((1 - f) * np.tan(np.radians(y2)))
        dl = np.radians((x2 - x1 + 180) % 360 - 180)
        lam = dl.copy()
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sig = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 1e-15, cs - 2 * s1 * s2 / ca2, 0)
            k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = dl + (1 - k) * f * sa * (sig + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = np.where(np.isfinite(new), new, lam)
            if done.all():
                break
        w2 = ca2 * (a * a - b * b) / (b * b)
        big = 1 + w2 / 16384 * (4096 + w2 * (-768 + w2 * (320 - 175 * w2)))
        small = w2 / 1024 * (256 + w2 * (-128 + w2 * (74 - 47 * w2)))
        ds = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        dist = b * big * (sig - ds)
        sphere = mean * np.arccos(np.clip(np.sin(np.radians(y1)) * np.sin(np.radians(y2)) + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.cos(dl), -1, 1))
        dist = np.where(ss == 0, 0.0, np.where(done, dist, sphere))
        lam, r1, r2 = np.where(done, lam, dl), np.radians(y1), np.radians(y2)
        p1, q1, p2, q2 = (np.where(done, u, v) for u, v in ((s1, np.sin(r1)), (c1, np.cos(r1)), (s2, np.sin(r2)), (c2, np.cos(r2))))
        az = np.arctan2(q2 * np.sin(lam), q1 * p2 - p1 * q2 * np.cos(lam)) % (2 * np.pi)
    return dist, az


WGS84 = Spheroid()


def haversine_term(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """sin²(half the central angle): grows with the distance, without root or arcsine."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = WGS84.mean_radius) -> Column:
    return 2 * radius * F.asin(F.sqrt(F.least(haversine_term(lon1, lat1, lon2, lat2), F.lit(1.0))))
