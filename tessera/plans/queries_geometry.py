"""Geometry, tracks and streaming-shaped queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import geometry as g
from tessera.operators import noding, satellite
from tessera.operators.axis import Axis
from tessera.streaming import binning

from .base import andoyer_sql, register, table


def boxes(spark, sf_dir):
    """A box and an L-shaped polygon for each nation."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "cast(n_nationkey * 13 % 60 as double) x", "cast(n_nationkey * 7 % 40 as double) y")
    ring = F.array(*[g.pt(F.col("x") + a, F.col("y") + b) for a, b in ((0, 0), (8, 0), (8, 3), (3, 3), (3, 6), (0, 6), (0, 0))])
    hole = F.array(F.array(*[g.pt(F.col("x") + a, F.col("y") + b) for a, b in ((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))]))
    return n.select("k", "x", "y", g.polygon(ring, hole).alias("poly"), g.box(F.col("x"), F.col("y"), F.col("x") + 8, F.col("y") + 6).alias("box"))


def spots(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 37 % 70 as double) px", "cast(s_suppkey * 17 % 50 as double) py")


#: Area of a quarter of a regular polygon in the unit circle, of the points that a buffer puts on it
_QUARTER = "(4.5 * sin(pi() / 18))"

_N = "n AS (SELECT n_nationkey AS k, (n_nationkey * 13 % 60)::DOUBLE AS x, (n_nationkey * 7 % 40)::DOUBLE AS y FROM nation)"
_S = "s AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 70)::DOUBLE AS px, (s_suppkey * 17 % 50)::DOUBLE AS py FROM supplier)"


@register(f"""WITH {_N} SELECT k, 32.0::DOUBLE AS area, 32.0::DOUBLE AS perimeter, 11::INT AS points_, 10 AS segments, 1 AS holes, x AS xmin, y AS ymin, x + 8 AS xmax, y + 6 AS ymax,
round(x + (8 * 3 * 4 + 3 * 3 * 1.5 - 1.5) / 32, 6) AS cx, round(y + (8 * 3 * 1.5 + 3 * 3 * 4.5 - 1.5) / 32, 6) AS cy FROM n""")
def geometry_measures(spark, sf_dir):
    p, b, c = F.col("poly"), g.bounds(F.col("poly")), g.centroid(F.col("poly"))
    d = boxes(spark, sf_dir)
    ring = F.get(F.get(p["parts"], F.lit(0)), F.lit(0))
    return d.select("k", g.area(p).alias("area"), g.perimeter(p).alias("perimeter"), (g.num_points(p) - 1).alias("points_"), g.num_segments(p).alias("segments"), g.num_interior_rings(p).alias("holes"), b["xmin"].alias("xmin"), b["ymin"].alias("ymin"), b["xmax"].alias("xmax"), b["ymax"].alias("ymax"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@register(f"""WITH {_N}, {_S} SELECT k, id FROM n, s WHERE px > x AND px < x + 8 AND py > y AND py < y + 6 AND NOT (px >= x + 3 AND py >= y + 3) AND NOT (px BETWEEN x + 1 AND x + 2 AND py BETWEEN y + 1 AND y + 2)""")
def within_join(spark, sf_dir):
    """Points strictly inside polygons; both sides are dealt to tiles first."""
    size = 5.0
    a = boxes(spark, sf_dir).withColumn("b", g.bounds(F.col("poly")))
    seq = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    a = a.withColumn("tx", F.explode(seq("b.xmin", "b.xmax"))).withColumn("ty", F.explode(seq("b.ymin", "b.ymax")))
    s = spots(spark, sf_dir).withColumns({"tx": F.floor(F.col("px") / size), "ty": F.floor(F.col("py") / size)})
    return a.join(s, ["tx", "ty"]).where(g.point_in(g.pt(F.col("px"), F.col("py")), F.col("poly"))).select("k", "id")


@register(f"""WITH {_N}, {_S} SELECT count(*) AS n, count(*) FILTER (px BETWEEN x AND x + 8 AND py BETWEEN y AND y + 6) AS covered FROM n JOIN s ON s.id % 25 = n.k""")
def covered_mask(spark, sf_dir):
    d = boxes(spark, sf_dir).join(spots(spark, sf_dir), F.expr("id % 25 = k"))
    return d.agg(F.count("*").alias("n"), F.count_if(g.point_in(g.pt(F.col("px"), F.col("py")), F.col("box"), True)).alias("covered"))


def _pairs(spark, sf_dir):
    d = boxes(spark, sf_dir)
    n = d.select((F.col("k") - 1).alias("k"), F.col("box").alias("box2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    # each box moved next to the following one by a step that depends on the key
    d = d.join(n, "k")
    moved = g.box(F.col("x") + F.pmod("k", F.lit(4)) * 4, F.col("y") + F.pmod("k", F.lit(3)) * 2, F.col("x") + F.pmod("k", F.lit(4)) * 4 + 8, F.col("y") + F.pmod("k", F.lit(3)) * 2 + 6)
    return d.withColumn("other", moved)


_PAIR = f"""{_N}, p AS (SELECT k, (k % 4) * 4.0 AS dx, (k % 3) * 2.0 AS dy FROM n WHERE k < 24), o AS (SELECT *, 8 - dx AS w, 6 - dy AS h FROM p)"""


@register(f"""WITH {_PAIR} SELECT k, w >= 0 AS intersects, w = 0 AS touches, dx = 0 AND dy = 0 AS equals, w > 0 AND NOT (dx = 0 AND dy = 0) AS overlaps, dx = 0 AND dy = 0 AS within, w < 0 AS disjoint FROM o""")
def geometry_predicates(spark, sf_dir):
    names = ("intersects", "touches", "equals", "overlaps", "within", "disjoint")
    r = noding.relations(_pairs(spark, sf_dir), ["k"], "box", "other")
    return r.select("k", *[noding.predicate(n, F.col("relation"), F.col("dim_a"), F.col("dim_b")).alias(n) for n in names])


@register(f"""WITH {_PAIR} SELECT k, round(greatest(w, 0) * h, 6) AS common, round(96 - greatest(w, 0) * h, 6) AS both_, round(48 - greatest(w, 0) * h, 6) AS rest, greatest(-w, 0)::DOUBLE AS gap FROM o""")
def geometry_overlay(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    out = noding.Pairs(d, ["k"], "box", "other").overlays("intersection", "union", "difference")
    size = lambda c: F.round(g.area(F.col(c)), 6)
    gap = d.select("k", g.distance(F.col("box"), F.col("other")).alias("gap"))
    return out.select("k", size("intersection").alias("common"), size("union").alias("both_"), size("difference").alias("rest")).join(gap, "k")


@register(f"""WITH {_N}, t AS (SELECT k, x::BIGINT AS x, y::BIGINT AS y FROM n) SELECT k, 'POLYGON((' || array_to_string([concat(x, ' ', y), concat(x + 8, ' ', y), concat(x + 8, ' ', y + 6), concat(x, ' ', y + 6), concat(x, ' ', y)], ',') || '))' AS wkt, 48.0::DOUBLE AS area_wkt,
'{{"type":"Polygon","coordinates":[[' || array_to_string([concat('[', x, ',', y, ']'), concat('[', x + 8, ',', y, ']'), concat('[', x + 8, ',', y + 6, ']'), concat('[', x, ',', y + 6, ']'), concat('[', x, ',', y, ']')], ',') || ']]}}' AS geojson, 48.0::DOUBLE AS area_json FROM t""")
def geometry_text(spark, sf_dir):
    d = boxes(spark, sf_dir).select("k", g.to_wkt(F.col("box")).alias("wkt"), g.to_geojson(F.col("box")).alias("geojson"))
    d = d.withColumns({"a": g.from_wkt(F.col("wkt")), "b": g.from_geojson(F.col("geojson"))})
    return d.select("k", "wkt", g.area(F.col("a")).alias("area_wkt"), "geojson", g.area(F.col("b")).alias("area_json"))


@register(f"""WITH {_N}, {_S} SELECT k, round(sum(d), 6) AS length, count(*)::INT AS segments FROM (SELECT n.k, sqrt((lead(px) OVER w - px) ** 2 + (lead(py) OVER w - py) ** 2) AS d FROM n JOIN s ON s.id % 25 = n.k WINDOW w AS (PARTITION BY n.k ORDER BY id)) WHERE d IS NOT NULL GROUP BY k""")
def line_length(spark, sf_dir):
    """A line through the points of each key."""
    d = spots(spark, sf_dir).groupBy(F.expr("cast(id % 25 as int)").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "px", "py"))), lambda p: g.pt(p["px"], p["py"])).alias("p"))
    line = g.line(F.col("p"))
    return d.select("k", F.round(g.length(line), 6).alias("length"), g.num_segments(line).alias("segments")).where("segments > 0")


# The hull cuts off the notch; every corner is farther than the tolerance from its chord; a buffer of 1 fills the hole and
# adds the perimeter of 28, five corners of inscribed quarter circles, less the overlap at the inner corner.
@register(f"""WITH {_N} SELECT k, 40.5::DOUBLE AS hull, 12::INT AS kept, round(33 + 28 + 5 * {_QUARTER} - 1, 4) AS buffer, true AS valid, true AS simple FROM n""")
def geometry_kernels(spark, sf_dir):
    """Hull, simplification, buffer and validity of the polygons."""
    p = F.col("poly")
    d = boxes(spark, sf_dir)
    simple = noding.simple(d.select("k", g.transform_to(F.col("box"), "linestring").alias("line")), ["k"], "line")
    wide = noding.buffer(d, ["k"], "poly", 1.0).select("k", F.round(g.area(F.col("geometry")), 4).alias("buffer"))
    d = d.select("k", F.round(g.area(g.convex_hull(p)), 6).alias("hull"), g.num_points(g.simplify(p, 0.5)).alias("kept"), g.is_valid(p).alias("valid"))
    return d.join(wide, "k").join(simple, "k").select("k", "hull", "kept", "buffer", "valid", "simple")


_AUTHALIC = "(s / (1 - e * e * s * s) + ln((1 + e * s) / (1 - e * s)) / (2 * e))"


# Between meridians and parallels: the zone's area on the spheroid, and two arcs of a parallel with two of meridians.
@register(f"""WITH {_N}, q AS (SELECT k, x, y, 0.0818191908426215 AS e, sin(radians(y)) AS s0, sin(radians(y + 6)) AS s1 FROM n)
SELECT k, round(6378137.0 ** 2 / 2 * radians(8) * (1 - e * e) * ({_AUTHALIC.replace('s', 's1')} - {_AUTHALIC.replace('s', 's0')}) / 1e6, 3) AS km2,
round({andoyer_sql('x', 'y', 'x + 8', 'y')} + {andoyer_sql('x', 'y + 6', 'x + 8', 'y + 6')} + 2 * ({andoyer_sql('x', 'y', 'x', 'y + 6')}), 1) AS perimeter FROM q""")
def geodetic_measures(spark, sf_dir):
    d = boxes(spark, sf_dir)
    b = F.col("box")
    return d.select("k", F.round(g.geodetic_area(b) / 1e6, 3).alias("km2"), F.round(g.perimeter(b, "andoyer"), 1).alias("perimeter"))


def track(spark, sf_dir):
    """Sine tracks that cross each other, a point for each event: 2000 events in turn are a track."""
    i, k = F.col("idx"), F.col("track")
    e = table(spark, sf_dir, "events").selectExpr("event_id div 2000 as track", "event_id % 2000 as idx")
    return e.select("track", "idx", (i * 1_000_000).alias("time"), (F.lit(-60.0) + i * (0.05 + 0.005 * (k % 4)) + k % 12 * 3).alias("lon"), (66.0 * F.sin(2 * 3.141592653589793 * (i + k * 300 + 0.25) / 1500)).alias("lat"))


_T = """t AS (SELECT track, idx, idx * 1000000 AS time, -60.0::DOUBLE + idx * (0.05::DOUBLE + 0.005::DOUBLE * (track % 4)) + track % 12 * 3 AS lon, 66.0::DOUBLE * sin(2 * 3.141592653589793::DOUBLE * (idx + track * 300 + 0.25::DOUBLE) / 1500) AS lat FROM (SELECT event_id // 2000 AS track, event_id % 2000 AS idx FROM events))"""


@register(f"""WITH {_T}, p AS (SELECT *, lead(lat) OVER w AS nl, lag(lat) OVER w AS pl FROM t WINDOW w AS (PARTITION BY track ORDER BY idx)), u AS (SELECT *, sign(coalesce(nl - lat, lat - pl)) AS up FROM p),
c AS (SELECT *, CASE WHEN coalesce(lag(up) OVER (PARTITION BY track ORDER BY idx) <> up, true) THEN 1 ELSE 0 END AS turned FROM u), q AS (SELECT *, sum(turned) OVER (PARTITION BY track ORDER BY idx) AS pass_no FROM c)
SELECT track, pass_no::BIGINT AS pass_no, count(*) AS n, min(idx) AS first, max(idx) AS last FROM q GROUP BY 1, 2""")
def orbit_passes(spark, sf_dir):
    return satellite.passes(track(spark, sf_dir), ["track"]).groupBy("track", "pass_no").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@register(f"""WITH {_T}, d AS (SELECT *, CASE WHEN lat < -50 THEN 'south' WHEN lat > 50 THEN 'north' ELSE 'mid' END AS tag FROM t), n AS (SELECT *, CASE WHEN coalesce(lag(tag) OVER w <> tag, true) THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY track ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY idx) AS run FROM n) SELECT track, min(idx) AS first, max(idx) AS last, count(*) AS n, min(tag) AS tag, round(min(lon), 6) AS xmin, round(max(lon), 6) AS xmax, round(min(lat), 6) AS ymin, round(max(lat), 6) AS ymax FROM r GROUP BY track, run""")
def track_decomposition(spark, sf_dir):
    out = satellite.decompose(track(spark, sf_dir), ["track"], min_edge=1)
    return out.select("track", "first", "last", "n", "tag", *[F.round(c, 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@register(f"""WITH {_T}, s AS (SELECT track, idx, lon AS x0, lat AS y0, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1 FROM t WINDOW w AS (PARTITION BY track ORDER BY idx)),
j AS (SELECT p.track AS track_a, q.track AS track_b, p.x0, p.y0, p.x1 - p.x0 AS a, p.y1 - p.y0 AS b, q.x1 - q.x0 AS c, q.y1 - q.y0 AS d, q.x0 - p.x0 AS ex, q.y0 - p.y0 AS ey FROM s p JOIN s q ON p.track = 0 AND q.track > 0 AND p.x1 IS NOT NULL AND q.x1 IS NOT NULL AND least(p.x0, p.x1) <= greatest(q.x0, q.x1) AND least(q.x0, q.x1) <= greatest(p.x0, p.x1)),
k AS (SELECT *, a * d - b * c AS det FROM j), m AS (SELECT *, (ex * d - ey * c) / det AS t, (ex * b - ey * a) / det AS u FROM k WHERE abs(det) > 1e-15)
SELECT track_a, track_b, round(x0 + t * a, 5) AS lon, round(y0 + t * b, 4) AS lat FROM m WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")
def track_crossovers(spark, sf_dir):
    t = track(spark, sf_dir)
    out = satellite.find_crossovers(t.where("track = 0"), t.where("track > 0"), ["track"])
    return out.select("track_a", "track_b", F.round("lon", 5).alias("lon"), F.round("lat", 4).alias("lat"))


@register(f"WITH {_T} SELECT DISTINCT track, 'prograde' AS direction FROM t")
def orbit_direction(spark, sf_dir):
    return satellite.infer_direction(track(spark, sf_dir), ["track"])


# Each point is turned about the direction of flight; latitudes come back by repeated correction.
@register(f"""WITH RECURSIVE {_T}, k AS (SELECT 6378137.0 AS a, 6378137.0 * (1 - 1 / 298.257223563) AS b, 0.0066943799901413165 AS e2),
e AS (SELECT track, idx, lat, a, b, e2, a / sqrt(1 - e2 * sin(radians(lat)) ** 2) AS n, lon FROM t, k),
p AS (SELECT *, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - e2) * sin(radians(lat)) AS z FROM e),
d AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS u, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS v, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS q FROM p WINDOW w AS (PARTITION BY track ORDER BY idx)),
f AS (SELECT *, sqrt(u * u + v * v + q * q) AS s, sqrt(((a * a * cos(radians(lat))) ** 2 + (b * b * sin(radians(lat))) ** 2) / ((a * cos(radians(lat))) ** 2 + (b * sin(radians(lat))) ** 2)) AS r FROM d),
h AS (SELECT track, a, e2, x, y, z, u / s AS u, v / s AS v, q / s AS q, r, sign(j) * ((abs(j) - 1) * 2.0 + 2.0) AS ac FROM f, range(-35, 36) i(j) WHERE j <> 0),
c AS (SELECT *, cos(ac * 1000 / r) AS c, sin(ac * 1000 / r) AS s, x * u + y * v + z * q AS o FROM h),
m AS (SELECT track, ac, a, e2, sqrt((x * c + (v * z - q * y) * s + u * o * (1 - c)) ** 2 + (y * c + (q * x - u * z) * s + v * o * (1 - c)) ** 2) AS rho, z * c + (u * y - v * x) * s + q * o * (1 - c) AS z FROM c),
l0 AS (SELECT *, atan2(z, rho * (1 - e2)) AS l FROM m), l1 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l0), l2 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l1),
l3 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l2), l4 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l3)
SELECT track, count(*) AS n, round(max(ac), 3) AS widest, round(avg(degrees(l)), 6) AS lat FROM l4 GROUP BY track""")
def orbit_swath(spark, sf_dir):
    out = satellite.calculate_swath(track(spark, sf_dir), ["track"])
    return out.groupBy("track").agg(F.count("*").alias("n"), F.round(F.max("x_ac"), 3).alias("widest"), F.round(F.avg("swath_lat"), 6).alias("lat"))


def _half_weights() -> str:
    """(first, last, offset, weight): what a point of the window adds to the natural spline halfway
    between the points 0 and 1 of a window of the points first..last."""
    rows = []
    for first in (0, -1, -2):
        for last in (1, 2, 3):
            n = last - first + 1
            a = np.eye(n)
            for i in range(1, n - 1):
                a[i, i - 1 : i + 2] = (1, 4, 1)
            bend = np.zeros((n, n))
            for i in range(1, n - 1):
                bend[i, i - 1 : i + 2] = (6, -12, 6)
            moments = np.linalg.solve(a, bend)
            w = (moments[-first] + moments[1 - first]) * -1 / 16
            w[-first] += 0.5
            w[1 - first] += 0.5
            rows += [f"({first}, {last}, {first + k}, {float(x)!r})" for k, x in enumerate(w)]
    return ", ".join(rows)


@register(f"""WITH {_T.replace('t AS', 't0 AS', 1)}, t AS (SELECT *, max(idx) OVER (PARTITION BY track) AS far FROM t0),
p AS (SELECT *, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - 0.0066943799901413165) * sin(radians(lat)) AS z FROM (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(lat)) ** 2) AS n FROM t)),
w(f, l, o, w) AS (VALUES {_half_weights()}),
h AS (SELECT c.track, 2 * c.idx + 1 AS idx, sum(w * p.x) AS x, sum(w * p.y) AS y, sum(w * p.z) AS z FROM t c JOIN w ON f = greatest(-2, -c.idx) AND l = least(3, c.far - c.idx) JOIN p ON p.track = c.track AND p.idx = c.idx + o WHERE c.idx < c.far GROUP BY 1, 2),
m AS (SELECT *, sqrt(x * x + y * y) AS rho, 6378137.0 AS a, 0.0066943799901413165 AS e2 FROM h),
l0 AS (SELECT *, atan2(z, rho * (1 - e2)) AS l FROM m), l1 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l0), l2 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l1),
l3 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l2), l4 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(l) ** 2) * sin(l), rho) AS l) FROM l3)
SELECT track, idx, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(l), 6) AS lat FROM l4 UNION ALL SELECT track, 2 * idx, round(lon, 6), round(lat, 6) FROM t WHERE idx < far""")
def orbit_resampled(spark, sf_dir):
    """Every half second."""
    t = track(spark, sf_dir)
    return satellite.interpolate_orbit(t, 500_000).select("track", "idx", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@register("SELECT o_orderkey, (o_orderkey // 254 + 1)::BIGINT AS cycle, (o_orderkey % 254 + 1)::BIGINT AS pass, o_orderkey + 1 AS absolute FROM orders")
def orbit_pass_numbers(spark, sf_dir):
    """Orders as passes, counted from 1."""
    o = satellite.Orbit(9_915_600_000_000 // 10, 254)
    d = table(spark, sf_dir, "orders").select("o_orderkey", o.decode_absolute_pass_number(F.col("o_orderkey") + 1).alias("d"))
    return d.select("o_orderkey", F.col("d.cycle").cast("long").alias("cycle"), F.col("d.pass").cast("long").alias("pass"), o.encode_absolute_pass_number(F.col("d.cycle"), F.col("d.pass")).alias("absolute"))


@register("""SELECT date_trunc('hour', ts) AS start, least(round(value / 100.0)::BIGINT, 5) AS ix, count(*) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def stream_binning(spark, sf_dir):
    """The streaming operator, run on the whole table as one batch."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = binning.binned(e, "ts", "value", "value", Axis.linspace(0.0, 100.0, 6))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "ix", "count", F.round("mean", 6).alias("mean"))
