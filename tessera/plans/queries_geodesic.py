"""Geodesics, their lengths and areas, against integrals taken in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geodesic
from tessera.operators import geometry as g

from .base import register
from .queries_functions import SQL_POINT, points

_X, _W = (str(v.tolist()) for v in np.polynomial.legendre.leggauss(24))
# The azimuth is found by halving; longitude and distance are integrals over the arc by Gauss's rule.
_F = "(1 / 298.257223563)"
_ARC = f"""sqrt(1 + k2 * sin(m + h * x[i]) ** 2)"""
_STEP = f"""(SELECT *, sin(al) * cb1 AS s0, sqrt(greatest(cos(al) ** 2 * cb1 ** 2 + (CASE WHEN cb1 < -sb1 THEN (cb2 - cb1) * (cb1 + cb2) ELSE (sb1 - sb2) * (sb1 + sb2) END), 0)) AS cc FROM {{0}})"""
_SIGMA = """(SELECT *, atan2(sb1, cos(al) * cb1) AS g1, atan2(sb2, cc) AS g2, atan2(s0 * sb1, cos(al) * cb1) AS o1, atan2(s0 * sb2, cc) AS o2, 0.0067394967422764341 * (1 - s0 * s0) AS k2 FROM {0})"""
_HALF = "(SELECT *, (g2 + g1) / 2 AS m, (g2 - g1) / 2 AS h FROM {0})"


def _reach(source: str) -> str:
    return _HALF.format(_SIGMA.format(_STEP.format(source)))


@register(f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, {SQL_POINT} FROM customer),
q AS (SELECT id, 'far' AS pair, lon AS lon1, lat AS lat1, 2.0::DOUBLE AS lon2, 48.0::DOUBLE AS lat2 FROM p UNION ALL SELECT id, 'opposite', lon, lat, lon + 179.75, 0.1::DOUBLE - lat FROM p),
c AS (SELECT id, pair, radians(abs((lon2 - lon1 + 540) % 360 - 180)) AS lam, -greatest(abs(lat1), abs(lat2)) AS y1, CASE WHEN abs(lat1) >= abs(lat2) THEN lat2 * (CASE WHEN lat1 > 0 THEN -1 ELSE 1 END) ELSE lat1 * (CASE WHEN lat2 > 0 THEN -1 ELSE 1 END) END AS y2 FROM q),
u AS (SELECT id, pair, lam, atan((1 - {_F}) * tan(radians(y1))) AS b1, atan((1 - {_F}) * tan(radians(y2))) AS b2, {_X} AS x, {_W} AS w FROM c),
t(id, pair, lam, sb1, cb1, sb2, cb2, x, w, lo, hi, al, n) AS (SELECT id, pair, lam, sin(b1), cos(b1), sin(b2), cos(b2), x, w, 0.0::DOUBLE, pi(), pi() / 2, 0 FROM u UNION ALL
  SELECT id, pair, lam, sb1, cb1, sb2, cb2, x, w, lo, hi, (lo + hi) / 2, n + 1 FROM (SELECT * REPLACE (CASE WHEN o2 - o1 - {_F} * s0 * h * list_sum(list_transform(range(1, 25), lambda i: w[i] * (2 - {_F}) / (1 + (1 - {_F}) * {_ARC}))) > lam THEN al ELSE hi END AS hi,
    CASE WHEN o2 - o1 - {_F} * s0 * h * list_sum(list_transform(range(1, 25), lambda i: w[i] * (2 - {_F}) / (1 + (1 - {_F}) * {_ARC}))) > lam THEN lo ELSE al END AS lo) FROM {_reach('t')} WHERE n < 54)),
e AS (SELECT * FROM t WHERE n = 54)
SELECT id, pair, round(6378137.0 * (1 - {_F}) * h * list_sum(list_transform(range(1, 25), lambda i: w[i] * {_ARC})), 4) AS metres FROM {_reach('e')}""")
def geodesic_distance(spark, sf_dir):
    """From each point to one place, and to one almost opposite."""
    p = points(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lon", "lat")
    far = p.select("id", F.lit("far").alias("pair"), "lon", "lat", F.lit(2.0).alias("x"), F.lit(48.0).alias("y"))
    both = far.union(p.select("id", F.lit("opposite"), "lon", "lat", F.col("lon") + 179.75, 0.1 - F.col("lat")))
    return both.select("id", "pair", F.round(geodesic.inverse(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))["distance"], 4).alias("metres"))


# A triangle of two meridians and the equator is a share of a hemisphere; a quarter meridian by Gauss's rule.
@register(f"""WITH p AS (SELECT c_custkey AS id, {SQL_POINT} FROM customer), k AS (SELECT 6378137.0 AS a, {_F} * (2 - {_F}) AS e2, {_X} AS x, {_W} AS w),
m AS (SELECT a, e2, a * (1 - e2) * pi() / 4 * list_sum(list_transform(range(1, 25), lambda i: w[i] * (1 - e2 * sin(pi() / 4 * (1 + x[i])) ** 2) ** (-1.5))) AS quarter, 2 * pi() * (a * a + a * a * (1 - e2) * ln((1 + sqrt(e2)) / (1 - sqrt(e2))) / 2 / sqrt(e2)) AS whole FROM k)
SELECT id, round(2 * quarter + a * radians(1 + id % 120), 3) AS around, round(whole / 2 * (1 + id % 120) / 360 / 1e6, 4) AS km2, round(a * radians(1 + id % 120), 4) AS base FROM p, m""")
def geodesic_triangles(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("w", 1.0 + F.col("c_custkey") % 120)
    ring = F.array(g.pt(F.col("lon"), F.lit(0.0)), g.pt(F.col("lon") + F.col("w"), F.lit(0.0)), g.pt(F.col("lon") + F.col("w"), F.lit(90.0)), g.pt(F.col("lon"), F.lit(90.0)), g.pt(F.col("lon"), F.lit(0.0)))
    t = g.polygon(ring)
    return p.select(F.col("c_custkey").alias("id"), F.round(g.perimeter(t, "karney"), 3).alias("around"), F.round(g.geodetic_area(t, strategy="karney") / 1e6, 4).alias("km2"), F.round(g.length(g.line(F.slice(ring, 1, 2)), "karney"), 4).alias("base"))
