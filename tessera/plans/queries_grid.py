"""Grid interpolation, gap filling, neighbour joins and scattered estimates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fill, grid, knn, scattered, tiles, windowed
from tessera.operators.axis import Axis, TemporalAxis
from tessera.session import saved

from .base import register, table

AX, AY = Axis.linspace(0.0, 5.0, 11), Axis.linspace(0.0, 0.02, 6)
AT = TemporalAxis.from_range(788_918_400_000_000, 31_536_000_000_000, 8)  # 1995 on, years of 365 days
AU = Axis.linspace(0.0, 2.0, 5)
#: value of a cell as a formula of its indices
FIELD2, FIELD3, FIELD4 = "i0 * i0 + 3.0 * i1", "i0 * i0 + 3.0 * i1 + 0.5 * i2 * i1", "i0 * i0 + 3.0 * i1 + 0.5 * i2 * i1 + i3"


def _grid(spark, axes, formula):
    cells = spark.range(1)
    for k, a in enumerate(axes):
        cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(a) - 1))).alias(f"i{k}"))
    return grid.Grid.from_cells(axes, cells.withColumn("v", F.expr(formula).cast("double")), [f"i{k}" for k in range(len(axes))], "v")


def _points(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    return d.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 103 / 2).alias("x"), (F.col("o_custkey") % 11 / 100).alias("y"), AT.ticks(F.col("o_orderdate")).alias("t"), (F.col("o_orderkey") % 17 / 2).alias("u"))


_D = "d AS (SELECT o_orderkey AS id, o_orderkey % 103 / 2 / 5.0 AS a, o_custkey % 11 / 100 / 0.02 AS b, (epoch_us(o_orderdate) - 788918400000000) / 31536000000000.0 AS c, o_orderkey % 17 / 2 / 2.0 AS e FROM orders)"
_E = ", e AS (SELECT id, a, b, c, e, least(floor(a), 9) AS i, least(floor(b), 4) AS j, least(floor(c), 6) AS k, least(floor(e), 3) AS l FROM d)"
_IN2, _IN3 = "a <= 10", "a <= 10 AND c BETWEEN 0 AND 7"


def _corner(i, j, k=None, l=None):  # noqa: E741
    f = f"(i+{i}) * (i+{i}) + 3.0 * (j+{j})"
    if k is not None:
        f += f" + 0.5 * (k+{k}) * (j+{j})"
    if l is not None:
        f += f" + (l+{l})"
    return f"({f})"


def _linear(n):
    out = []
    for m in range(1 << n):
        b = [(m >> q) & 1 for q in range(n)]
        w = " * ".join(f"(({x}-{y}))" if v else f"(1-({x}-{y}))" for v, x, y in zip(b, "abce", "ijkl", strict=False))
        out.append(f"{w} * {_corner(*b)}")
    return " + ".join(out)


@register(f"WITH {_D}{_E} SELECT id, CASE WHEN {_IN2} THEN round({_linear(2)}, 6) END AS value FROM e")
def bilinear(spark, sf_dir):
    out = grid.interpolate(_grid(spark, [AX, AY], FIELD2), _points(spark, sf_dir), "id", ["x", "y"])
    return out.select("id", F.round("value", 6).alias("value"))


@register(f"WITH {_D}{_E} SELECT id, CASE WHEN {_IN3} THEN round({_linear(3)}, 5) END AS value FROM e")
def trivariate_time(spark, sf_dir):
    out = grid.interpolate(_grid(spark, [AX, AY, AT], FIELD3), _points(spark, sf_dir), "id", ["x", "y", "t"])
    return out.select("id", F.round("value", 5).alias("value"))


@register(f"WITH {_D}{_E} SELECT id, CASE WHEN {_IN3} THEN round({_linear(4)}, 5) END AS value FROM e")
def quadrivariate(spark, sf_dir):
    out = grid.interpolate(_grid(spark, [AX, AY, AT, AU], FIELD4), _points(spark, sf_dir), "id", ["x", "y", "t", "u"])
    return out.select("id", F.round("value", 5).alias("value"))


_HAV = "(sin(radians(b*0.02 - (j+{q})*0.02)/2)**2 + cos(radians(b*0.02)) * cos(radians((j+{q})*0.02)) * sin(radians(a*5 - (i+{p})*5)/2)**2)"
_CORNERS = ", c AS (" + " UNION ALL ".join(f"SELECT id, a, {2 * p + q} AS n, {_HAV.replace('{p}', str(p)).replace('{q}', str(q))} AS h, {_corner(p, q)} AS v FROM e" for p in (0, 1) for q in (0, 1)) + ")"


@register(f"WITH {_D}{_E}{_CORNERS} SELECT id, CASE WHEN max(a) <= 10 THEN round(coalesce(min(v) FILTER (h <= 1e-24), sum(v / h) FILTER (h > 1e-24) / sum(1 / h) FILTER (h > 1e-24)), 5) END AS value FROM c GROUP BY id")
def grid_inverse_distance(spark, sf_dir):
    out = grid.interpolate(_grid(spark, [AX, AY], FIELD2), _points(spark, sf_dir), "id", ["x", "y"], "idw")
    return out.select("id", F.round("value", 5).alias("value"))


@register("SELECT o_orderkey AS id, CASE WHEN round(o_orderkey % 103 / 2 / 5.0) <= 10 THEN round(o_orderkey % 103 / 2 / 5.0) ** 2 + 3.0 * round(o_custkey % 11 / 100 / 0.02) END AS value FROM orders")
def grid_nearest_cell(spark, sf_dir):
    return _grid(spark, [AX, AY], FIELD2).nearest(_points(spark, sf_dir), ["x", "y"]).select("id", "value")


def _daily(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return d.select(F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double").alias("x"), "v")


@register("""WITH s AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS x, avg(value) AS v FROM events GROUP BY 1), p AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS t FROM events)
SELECT event_id, round(a.v + (b.v - a.v) * (t - a.x), 6) AS value, round(b.v - a.v, 6) AS derivative FROM p LEFT JOIN s a ON a.x = least(floor(t), 28)::BIGINT AND t <= 29 LEFT JOIN s b ON b.x = a.x + 1""")
def univariate_linear(spark, sf_dir):
    """Daily means as a one-dimensional grid, read at the time of each event."""
    axis = Axis.linspace(0.0, 1.0, 30)
    g = grid.Grid.from_coordinates([axis], _daily(spark, sf_dir), ["x"], "v")
    p = table(spark, sf_dir, "events").select("event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 86_400_000_000).alias("t"))
    out = windowed.interpolate(g, p, "event_id", ["t"], "linear", half=1, boundary="shrink", derivative=True)
    return out.select("event_id", F.round("value", 6).alias("value"), F.round("derivative", 6).alias("derivative"))


@register("""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 103 / 2 / 5.0 AS a, o_custkey % 11 / 100 / 0.02 AS b FROM orders)
SELECT id, CASE WHEN a >= 2 AND a < 8 AND b >= 2 AND b < 3 THEN round(a * a + 3.0 * b, 5) END AS value FROM d""")
def windowed_polynomial(spark, sf_dir):
    out = windowed.interpolate(_grid(spark, [AX, AY], FIELD2), _points(spark, sf_dir), "id", ["x", "y"], "polynomial")
    return out.select("id", F.round("value", 5).alias("value"))


# The natural spline of i * i over four nodes has the second derivatives 0, 2.4, 2.4, 0; along the other axes the field is linear.
@register(f"""WITH {_D}{_E}, f AS (SELECT *, a - i AS f FROM e)
SELECT id, CASE WHEN {_IN3} AND i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 3 THEN round((1 - f) * i * i + f * (i + 1) ** 2 - 0.4 * ((1 - f) - (1 - f) ** 3 + f - f ** 3) + 3.0 * b + 0.5 * c * b, 5) END AS value FROM f""")
def windowed_bicubic(spark, sf_dir):
    """Spline surface in three dimensions, time linear."""
    out = windowed.interpolate(_grid(spark, [AX, AY, AT], FIELD3), _points(spark, sf_dir), "id", ["x", "y", "t"], "bicubic", half=2, boundary="shrink")
    return out.select("id", F.round("value", 5).alias("value"))


# Slopes of six days (five next to the ends) around the event: the means of the outer ones are those of the window's ends.
@register("""WITH s AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS x, avg(value) AS v FROM events GROUP BY 1), p AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS t FROM events),
d AS (SELECT x, v, lead(v) OVER w - v AS d FROM s WINDOW w AS (ORDER BY x)),
e AS (SELECT *, lag(d, 2) OVER w AS d2, lag(d) OVER w AS d1, lead(d) OVER w AS e1 FROM d WINDOW w AS (ORDER BY x)),
f AS (SELECT *, CASE WHEN d2 IS NULL OR e1 IS NULL THEN (d1 + d) / 2 WHEN abs(e1 - d) + abs(d1 - d2) > 0 THEN (abs(e1 - d) * d1 + abs(d1 - d2) * d) / (abs(e1 - d) + abs(d1 - d2)) ELSE (d1 + d) / 2 END AS s FROM e),
q AS (SELECT event_id, t, least(floor(t), 28)::BIGINT AS i FROM p WHERE t <= 29)
SELECT event_id, round(a.v + h * (a.s + h * (3 * a.d - 2 * a.s - b.s + h * (a.s + b.s - 2 * a.d))), 6) AS value, round(a.s + h * (2 * (3 * a.d - 2 * a.s - b.s) + 3 * h * (a.s + b.s - 2 * a.d)), 6) AS derivative
FROM p LEFT JOIN (SELECT *, t - i AS h FROM q) USING (event_id) LEFT JOIN f a ON a.x = i AND i BETWEEN 1 AND 27 LEFT JOIN f b ON b.x = i + 1 AND i BETWEEN 1 AND 27""")
def windowed_akima(spark, sf_dir):
    axis = Axis.linspace(0.0, 1.0, 30)
    g = grid.Grid.from_coordinates([axis], _daily(spark, sf_dir), ["x"], "v")
    p = table(spark, sf_dir, "events").select("event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 86_400_000_000).alias("t"))
    out = windowed.interpolate(g, p, "event_id", ["t"], "akima", half=3, boundary="shrink", derivative=True)
    return out.select("event_id", F.round("value", 6).alias("value"), F.round("derivative", 6).alias("derivative"))


def _sites(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as qid", "cast(s_suppkey * 37 % 360 - 180 as double) lon", "cast(s_suppkey * 17 % 160 - 80 as double) lat")
    o = table(spark, sf_dir, "customer").selectExpr("c_custkey as oid", "cast(c_custkey * 53 % 360 - 180 as double) + 0.25 lon", "cast(c_custkey * 29 % 160 - 80 as double) + 0.25 lat", "c_acctbal as value")
    return knn.to_ecef(q, "lon", "lat"), knn.to_ecef(o, "lon", "lat")


_ECEF = "n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - 0.006694379990141316) * sin(radians(lat)) AS z FROM (SELECT *, 6378137.0 / sqrt(1 - 0.006694379990141316 * sin(radians(lat)) ** 2) AS n FROM "
_KNN = f"""q AS (SELECT qid, {_ECEF} (SELECT s_suppkey AS qid, (s_suppkey * 37 % 360 - 180)::DOUBLE AS lon, (s_suppkey * 17 % 160 - 80)::DOUBLE AS lat FROM supplier))),
o AS (SELECT oid, value, {_ECEF} (SELECT c_custkey AS oid, c_acctbal AS value, (c_custkey * 53 % 360 - 180)::DOUBLE + 0.25 AS lon, (c_custkey * 29 % 160 - 80)::DOUBLE + 0.25 AS lat FROM customer))),
p AS (SELECT qid, oid, value, sqrt((q.x - o.x) ** 2 + (q.y - o.y) ** 2 + (q.z - o.z) ** 2) AS d, q.x AS qx, q.y AS qy, q.z AS qz, o.x, o.y, o.z FROM q, o),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 4), oid) AS r FROM p)"""


def _neighbours(spark, sf_dir, **how):
    q, o = _sites(spark, sf_dir)
    return q, knn.knn_join(q, o, ["x", "y", "z"], carry=["value", *how.pop("carry", [])], **how)


@register(f"WITH {_KNN} SELECT qid, r AS rank, round(d, 2) AS distance FROM k WHERE r <= 8")
def knn_join(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir, k=8)
    return n.select("qid", F.col("rank").cast("long").alias("rank"), F.round("distance", 2).alias("distance"))


@register(f"WITH {_KNN} SELECT qid, count(*) AS n, round(sum(d), 1) AS total FROM p WHERE d <= 1000000 GROUP BY qid")
def radius_join(spark, sf_dir):
    q, o = _sites(spark, sf_dir)
    return knn.radius_totals(q, o, ["x", "y", "z"], 1_000_000.0).select("qid", "n", F.round("total", 1).alias("total"))


@register(f"WITH {_KNN}, t AS (SELECT * FROM k WHERE r <= 8 AND d <= 2000000), b AS (SELECT qid FROM t GROUP BY qid HAVING min(qx) BETWEEN min(x) AND max(x) AND min(qy) BETWEEN min(y) AND max(y) AND min(qz) BETWEEN min(z) AND max(z)) SELECT qid, count(*) AS n FROM t JOIN b USING (qid) GROUP BY qid")
def knn_envelope(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir, k=8, radius=2_000_000.0, boundary="envelope")
    return n.groupBy("qid").agg(F.count("*").alias("n"))


@register(f"WITH {_KNN} SELECT qid, round(sum(value / (d * d)) / sum(1 / (d * d)), 4) AS value, count(*) AS neighbours FROM k WHERE r <= 11 GROUP BY qid")
def inverse_distance(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir, k=11)
    return scattered.inverse_distance(n).select("qid", F.round("value", 4).alias("value"), "neighbours")


@register(f"""WITH {_KNN}, t AS (SELECT *, pi() * (d / 3000000 + 1) AS u FROM k WHERE r <= 11 AND d <= 3000000),
w AS (SELECT *, 0.35875 - 0.48829 * cos(u) + 0.14128 * cos(2 * u) - 0.01168 * cos(3 * u) AS w FROM t) SELECT qid, round(sum(w * value) / sum(w), 4) AS value, count(*) AS neighbours FROM w GROUP BY qid""")
def window_function_mean(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir, k=11, radius=3_000_000.0)
    return scattered.window_mean(n, "blackman_harris", 3_000_000.0).select("qid", F.round("value", 4).alias("value"), "neighbours")


def _each(parts: dict[str, str]) -> str:
    """One table of the results of several complete statements."""
    return " UNION ALL ".join(f"SELECT '{name}' AS kind, * FROM ({sql})" for name, sql in parts.items())


_COS = {
    "boxcar": "1",
    "hamming": (0.53836, 0.46164),
    "blackman": (7938 / 18608, 9240 / 18608, 1430 / 18608),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "flat_top": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}
_SINC = "CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END"
#: argument and SQL of every window, of q = distance / radius; all neighbours lie within twice the radius
_WINDOW_SQL = {name: (None, "CASE WHEN q <= 1 THEN " + (c if isinstance(c, str) else " ".join(f"{'+' if i % 2 == 0 else '-'} {a!r} * cos({i} * pi() * (q + 1))" for i, a in enumerate(c))) + " ELSE 0 END") for name, c in _COS.items()} | {
    "gaussian": (900_000.0, "CASE WHEN q <= 1 THEN exp(-0.5 * (d / 900000.0) ** 2) ELSE 0 END"),
    "lanczos": (2.0, f"({_SINC.format(x='q')}) * ({_SINC.format(x='(q / 2)')})"),
    "parzen": (400_000.0, "CASE WHEN d <= 800000 THEN 1 - 6 * q ** 2 * (1 - q) WHEN d <= 1600000 THEN 2 * (1 - q) ** 3 ELSE 0 END"),
    "parzen_swot": (None, "CASE WHEN q <= 0.5 THEN 1 - 6 * q ** 2 * (1 - q) WHEN q <= 1 THEN 2 * (1 - q) ** 3 ELSE 0 END"),
}


@register(f"WITH {_KNN}, t AS (SELECT *, d / 1400000.0 AS q FROM k WHERE r <= 20 AND d <= 2800000)" + _each({kind: f"SELECT qid, round(sum(w * value) / sum(w), 3) AS value, CASE WHEN sum(w) <> 0 THEN count(*) ELSE 0 END AS neighbours FROM (SELECT qid, value, {sql} AS w FROM t) GROUP BY qid" for kind, (_, sql) in _WINDOW_SQL.items()}))
def window_kernels(spark, sf_dir):
    """Every window with a radius of 1400 km, over neighbours within twice that."""
    _, n = _neighbours(spark, sf_dir, k=20, radius=2_800_000.0)
    n = saved(n)
    out = [scattered.window_mean(n, kind, 1_400_000.0, arg).select(F.lit(kind).alias("kind"), "qid", F.round("value", 3).alias("value"), "neighbours") for kind, (arg, _) in _WINDOW_SQL.items()]
    return reduce(DataFrame.union, out)


def _solver_input(spark, sf_dir, k):
    q, o = _sites(spark, sf_dir)
    km = lambda d: d.withColumns({c: F.col(c) / 1e6 for c in "xyz"})
    q, o = km(q), km(o)
    n = knn.knn_join(q, o, ["x", "y", "z"], k=k, carry=["value"])
    return q, n.join(o.select("oid", "x", "y", "z"), "oid")


def _solve_sql(k: int, pair: str, point: str, right: str | None = None, extra: str = "", drift: bool = False) -> str:
    """CTEs that solve one linear system for each qid by elimination: t has its k nearest sites, c the
    entries ``pair`` (of d, the distance of sites a and b), with ``point`` of a site and the query as
    right side (or ``right`` of the site a); w has the solution s, the values v and the point terms p."""
    rows = "list(m ORDER BY r) AS m"
    lines = f"SELECT qid, r, list_append(array_agg(e ORDER BY r2), any_value(h)) AS m FROM c GROUP BY qid, r"
    if drift:  # saddle system with the terms 1, x, y, z below and beside
        terms = [("1.0", "1.0"), ("x", "qx"), ("y", "qy"), ("z", "qz")]
        lines = f"SELECT qid, r, list_concat(array_agg(e ORDER BY r2), [any_value(ax) * 0 + 1, any_value(ax), any_value(ay), any_value(az), any_value(h)]) AS m FROM c GROUP BY qid, r"
        for i, (f, f0) in enumerate(terms):
            lines += f" UNION ALL SELECT qid, {k + 1 + i} AS r, list_concat(array_agg({f} ORDER BY r), [0.0, 0.0, 0.0, 0.0, any_value({f0})]) AS m FROM t GROUP BY qid"
    return f"""t AS MATERIALIZED (SELECT qid, r, oid, value, d / 1e6 AS d, qx / 1e6 AS qx, qy / 1e6 AS qy, qz / 1e6 AS qz, x / 1e6 AS x, y / 1e6 AS y, z / 1e6 AS z FROM k WHERE r <= {k}),
j AS (SELECT a.qid, a.r, b.r AS r2, a.value, a.oid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.qx, a.qy, a.qz, a.d AS dq, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM t a JOIN t b USING (qid)){extra},
c AS MATERIALIZED (SELECT *, {pair} AS e, {right or point} AS h, {point} AS p FROM j),
l AS ({lines}), y AS (SELECT qid, 1 AS i, {rows} FROM l GROUP BY qid),
g AS (SELECT * FROM y UNION ALL SELECT qid, i + 1, list_transform(m, lambda r, n: CASE WHEN n = i THEN list_transform(r, lambda x: x / m[i][i]) ELSE list_transform(r, lambda x, o: x - r[i] * m[i][o] / m[i][i]) END) FROM g WHERE i <= len(m)),
v AS (SELECT qid, array_agg(value ORDER BY r) AS v, array_agg(p ORDER BY r) AS p FROM c WHERE r2 = 1 GROUP BY qid),
w AS (SELECT qid, list_transform(m, lambda r: r[len(r)])[1:{k}] AS s, v, p FROM g JOIN v USING (qid) WHERE i = len(m) + 1)"""


_RBF_SQL = {
    "cubic": "{d} ** 3",
    "gaussian": "exp(-(({d} / {e}) ** 2))",
    "inverse_multiquadric": "1 / sqrt(1 + ({d} / {e}) ** 2)",
    "linear": "{d}",
    "multiquadric": "sqrt(1 + ({d} / {e}) ** 2)",
    "thin_plate": "CASE WHEN {d} > 1e-15 THEN {d} ** 2 * ln(greatest({d}, 1e-300)) ELSE 0 END",
}


def _rbf_sql(kind: str, k: int, epsilon: str) -> str:
    f, e = _RBF_SQL[kind], epsilon
    extra = f", ja AS (SELECT qid, sum(d) / ({k} * ({k} - 1)) AS mean FROM j GROUP BY qid)"
    solve = _solve_sql(k, "(" + f.format(d="d", e=e) + ") + CASE WHEN r = r2 THEN 0.1 ELSE 0 END", f.format(d="dq", e=e), "value", extra)
    return solve.replace("FROM j),\nl AS", "FROM j JOIN ja USING (qid)),\nl AS")


@register(f"WITH RECURSIVE {_KNN}, {_rbf_sql('multiquadric', 8, 'mean')} SELECT qid, round(list_dot_product(s, p), 2) AS value, 8 AS neighbours FROM w")
def radial_basis(spark, sf_dir):
    q, n = _solver_input(spark, sf_dir, 8)
    return scattered.radial_basis(n, q, ["x", "y", "z"], smooth=0.1).select("qid", F.round("value", 2).alias("value"), F.col("neighbours").cast("int").alias("neighbours"))


@register(_each({kind: f"WITH RECURSIVE {_KNN}, {_rbf_sql(kind, 4, '2.5')} SELECT qid, round(list_dot_product(s, p), 2) AS value FROM w" for kind in _RBF_SQL}))
def radial_basis_kernels(spark, sf_dir):
    """Every function, with an epsilon of 2.5 thousand kilometres."""
    q, n = _solver_input(spark, sf_dir, 4)
    n = saved(n)
    out = [scattered.radial_basis(n, q, ["x", "y", "z"], kind, 2.5, 0.1).select(F.lit(kind).alias("kind"), "qid", F.round("value", 2).alias("value")) for kind in scattered.RBF]
    return reduce(DataFrame.union, out)


_COVARIANCE_SQL = {
    "matern_12": "exp(-{q})",
    "matern_32": "(1 + sqrt(3) * {q}) * exp(-sqrt(3) * {q})",
    "matern_52": "(1 + sqrt(5) * {q} + 5 / 3.0 * {q} ** 2) * exp(-sqrt(5) * {q})",
    "cauchy": "1 / (1 + {q} ** 2)",
    "spherical": "CASE WHEN {q} < 1 THEN 1 - 1.5 * {q} + 0.5 * {q} ** 3 ELSE 0 END",
    "gaussian": "exp(-({q} ** 2))",
    "wendland": "CASE WHEN {q} < 1 THEN (1 - {q}) ** 2 ELSE 0 END",
}


def _kriging_sql(kind: str, k: int, length: float, nugget: float, drift: bool = False, digits: int = 4) -> str:
    f = _COVARIANCE_SQL[kind]
    solve = _solve_sql(k, f"({f.format(q=f'(d / {length})')}) + CASE WHEN r = r2 THEN {nugget} ELSE 0 END", f.format(q=f"(dq / {length})"), drift=drift)
    return f"WITH RECURSIVE {_KNN}, {solve} SELECT qid, round(list_dot_product(s, v), {digits}) AS value"


@register(_each({kind: _kriging_sql(kind, 5, 2.5, 0.05) + " FROM w" for kind in _COVARIANCE_SQL}))
def kriging_kernels(spark, sf_dir):
    """Simple kriging with every covariance."""
    q, n = _solver_input(spark, sf_dir, 5)
    n = saved(n)
    out = [scattered.kriging(n, q, ["x", "y", "z"], kind, 1.0, 2.5, 0.05).select(F.lit(kind).alias("kind"), "qid", F.round("value", 4).alias("value")) for kind in scattered.COVARIANCE]
    return reduce(DataFrame.union, out)


@register(_kriging_sql("matern_32", 8, 2.0, 0.01) + ", 8 AS neighbours FROM w")
def kriging(spark, sf_dir):
    q, n = _solver_input(spark, sf_dir, 8)
    return scattered.kriging(n, q, ["x", "y", "z"], "matern_32", 1.0, 2.0, 0.01).select("qid", F.round("value", 4).alias("value"), F.col("neighbours").cast("int").alias("neighbours"))


@register(_kriging_sql("spherical", 12, 3.0, 0.05, True, 3) + ", 12 AS neighbours FROM w")
def kriging_universal(spark, sf_dir):
    q, n = _solver_input(spark, sf_dir, 12)
    return scattered.kriging(n, q, ["x", "y", "z"], "spherical", 1.0, 3.0, 0.05, drift="linear").select("qid", F.round("value", 3).alias("value"), F.col("neighbours").cast("int").alias("neighbours"))


_OI = _solve_sql(12, "exp(-((ax - bx) ** 2 + ((ay - by_) / 1.5) ** 2 + ((az - bz) / 2.0) ** 2)) + CASE WHEN r = r2 THEN 0.1 + oid % 5 * 0.1 ELSE 0 END", "exp(-((ax - qx) ** 2 + ((ay - qy) / 1.5) ** 2 + ((az - qz) / 2.0) ** 2))")


@register(f"WITH RECURSIVE {_KNN}, {_OI} SELECT qid, round(list_dot_product(s, v), 4) AS value, round(sqrt(greatest(1 - list_dot_product(s, p), 0)), 6) AS std, 12 AS neighbours FROM w")
def optimal_interpolation(spark, sf_dir):
    q, n = _solver_input(spark, sf_dir, 12)
    n = n.withColumn("sigma2", F.lit(0.1) + F.pmod("oid", F.lit(5)) * 0.1)
    out = scattered.optimal_interpolation(n, q, ["x", "y", "z"], [1.0, 1.5, 2.0])
    return out.select("qid", F.round("value", 4).alias("value"), F.round("std", 6).alias("std"), F.col("neighbours").cast("int").alias("neighbours"))


def _gappy(spark, sf_dir):
    """Mean value by event type (ix) and day (iy), with gaps."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("iy")).agg(F.avg("value").alias("v"))
    types = e.select("event_type").distinct()
    rank = types.alias("a").join(types.alias("b"), F.expr("b.event_type < a.event_type"), "left").groupBy("a.event_type").agg(F.count("b.event_type").alias("ix"))
    g = g.join(rank, "event_type")
    return g.select("ix", "iy", F.when((F.col("ix") * 7 + F.col("iy") * 3) % 5 != 0, F.col("v")).alias("v"))


_GAPPY = """g AS (SELECT event_type, datediff('day', DATE '2024-01-01', ts::DATE) AS iy, avg(value) AS v FROM events GROUP BY 1, 2),
k AS (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS ix FROM g), m AS (SELECT ix, iy, CASE WHEN (ix * 7 + iy * 3) % 5 <> 0 THEN v END AS v FROM k)"""


_LINES = f"""WITH {_GAPPY}, a AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN iy END IGNORE NULLS) OVER (PARTITION BY ix ORDER BY iy) AS p, first_value(CASE WHEN v IS NOT NULL THEN iy END IGNORE NULLS) OVER (PARTITION BY ix ORDER BY iy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q,
min(iy) FILTER (v IS NOT NULL) OVER (PARTITION BY ix) AS f, max(iy) FILTER (v IS NOT NULL) OVER (PARTITION BY ix) AS l FROM m)
SELECT a.ix, a.iy, round(coalesce(a.v, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN b.v + (c.v - b.v) * (a.iy - p) / (q - p) WHEN p IS NOT NULL THEN e.v + (e.v - d.v) / (l - f) * (a.iy - l) ELSE d.v + (e.v - d.v) / (l - f) * (a.iy - f) END), 6) AS filled
FROM a LEFT JOIN m b ON b.ix = a.ix AND b.iy = p LEFT JOIN m c ON c.ix = a.ix AND c.iy = q LEFT JOIN m d ON d.ix = a.ix AND d.iy = f LEFT JOIN m e ON e.ix = a.ix AND e.iy = l"""


@register(_LINES)
def fill_vector(spark, sf_dir):
    return fill.vector(_gappy(spark, sf_dir), "iy", "v", ["ix"]).select("ix", "iy", F.round("filled", 6).alias("filled"))


@register(f"""WITH {_GAPPY}, s AS (SELECT t.ix, t.iy, s.v, (1 - sqrt((dx / 2.0) ** 2 + (dy / 3.0) ** 2) ** 3) ** 3 AS w FROM m t, range(-1, 2) x(dx), range(-2, 3) y(dy), m s
WHERE s.ix = CASE WHEN t.ix + dx < 0 THEN -(t.ix + dx) WHEN t.ix + dx > 4 THEN 8 - (t.ix + dx) ELSE t.ix + dx END AND s.iy = CASE WHEN t.iy + dy < 0 THEN -(t.iy + dy) WHEN t.iy + dy > 29 THEN 58 - (t.iy + dy) ELSE t.iy + dy END AND s.v IS NOT NULL AND sqrt((dx / 2.0) ** 2 + (dy / 3.0) ** 2) <= 1),
h AS (SELECT ix, iy, sum(w * v) / sum(w) AS smooth FROM s GROUP BY 1, 2) SELECT m.ix, m.iy, round(coalesce(m.v, smooth), 6) AS filled FROM m LEFT JOIN h ON h.ix = m.ix AND h.iy = m.iy""")
def fill_loess(spark, sf_dir):
    return fill.loess(_gappy(spark, sf_dir), "v", 1, 2, (5, 30)).select("ix", "iy", F.round("filled", 6).alias("filled"))


def _field(spark, sf_dir):
    return _gappy(spark, sf_dir).withColumn("g", F.lit(1))


@register(_LINES)  # every row of the sample has a value, so the second pass has nothing to fill
def fill_matrix(spark, sf_dir):
    return fill.matrix(_gappy(spark, sf_dir), "v").select("ix", "iy", F.round("filled", 6).alias("filled"))


_WHOLE = f"""{_GAPPY}, r AS (SELECT i, j, v FROM range(5) a(i), range(30) b(j) LEFT JOIN m ON m.ix = i AND m.iy = j),
z AS (SELECT array_agg(g ORDER BY i) AS g, array_agg(u ORDER BY i) AS u FROM (SELECT i, array_agg(v IS NULL ORDER BY j) AS g, array_agg(coalesce(v, zonal, 0) ORDER BY j) AS u FROM (SELECT *, avg(v) OVER (PARTITION BY j) AS zonal FROM r) GROUP BY i))"""


def _table_sql(result: str, digits: int) -> str:
    return f"SELECT ix, iy, round(u[ix + 1][iy + 1], {digits}) AS filled FROM m, ({result})"


#: Jacobi steps to the limit that every relaxation has
_LAPLACE = f"""WITH RECURSIVE {_WHOLE}, s AS (SELECT 0 AS n, g, u FROM z UNION ALL
SELECT n + 1, g, list_transform(u, lambda row, i: list_transform(row, lambda x, j: CASE WHEN g[i][j] THEN (u[CASE WHEN i = 1 THEN 2 ELSE i - 1 END][j] + u[CASE WHEN i = 5 THEN 4 ELSE i + 1 END][j] + u[i][CASE WHEN j = 1 THEN 2 ELSE j - 1 END] + u[i][CASE WHEN j = 30 THEN 29 ELSE j + 1 END]) / 4 ELSE x END)) FROM s WHERE n < 300)
{_table_sql("SELECT u FROM s WHERE n = 300", 6)}"""


def _low_pass(n: int, sigma: float) -> str:
    """The Gaussian low pass of n mirrored points as a matrix: means of cosines."""
    k = np.arange(n)
    c = np.cos(np.pi * np.outer(k + 0.5, k) / n) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    m = (c * np.exp(-(k**2) / (2 * sigma * sigma))) @ c.T
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in m) + "]"


_INPAINT = f"""WITH RECURSIVE {_WHOLE}, low AS MATERIALIZED (SELECT {_low_pass(5, 3.0)}::DOUBLE[][] AS kx, {_low_pass(30, 3.0)}::DOUBLE[][] AS ky),
s AS (SELECT 0 AS n, 1.0::DOUBLE AS rest, g, u FROM z UNION ALL
SELECT n + 1, list_max(list_transform(range(1, 6), lambda i: list_max(list_transform(range(1, 31), lambda j: CASE WHEN g[i][j] THEN abs(w[i][j] - u[i][j]) ELSE 0 END)))), g,
list_transform(u, lambda row, i: list_transform(row, lambda x, j: CASE WHEN g[i][j] THEN w[i][j] ELSE x END))
FROM (SELECT n, g, u, list_transform(range(1, 6), lambda i: list_transform(range(1, 31), lambda j: kx[i][1] * t[1][j] + kx[i][2] * t[2][j] + kx[i][3] * t[3][j] + kx[i][4] * t[4][j] + kx[i][5] * t[5][j])) AS w
FROM (SELECT n, g, u, kx, list_transform(u, lambda row: list_transform(ky, lambda c: list_dot_product(c, row))) AS t FROM s, low WHERE rest >= 1e-4 AND n < 500)))
{_table_sql("SELECT u FROM s ORDER BY n DESC LIMIT 1", 5)}"""


def _solved(name, digits, **options):
    def q(spark, sf_dir):
        out = fill.solve(_field(spark, sf_dir), "v", name, ["g"], **options)
        return out.select("ix", "iy", F.round("filled", digits).alias("filled"))

    q.__name__ = f"fill_{name}"
    return q


for _name, _options, _sql in (("gauss_seidel", {"digits": 6, "epsilon": 1e-12, "iterations": 20_000}, _LAPLACE), ("multigrid", {"digits": 6, "epsilon": 1e-12, "iterations": 2_000}, _LAPLACE), ("fft_inpaint", {"digits": 5, "sigma": 3.0}, _INPAINT)):
    register(_sql)(_solved(_name, **_options))


# fields in tiles

_FIELD = """f AS (SELECT l_partkey % 64 AS ix, (l_suppkey * 7 + l_linenumber * 5) % 64 AS iy, max(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2), m AS (SELECT ix, iy, CASE WHEN (ix * 7 + iy * 3) % 5 <> 0 THEN a END AS v FROM f),
r AS (SELECT i, j, v FROM range(64) a(i), range(64) b(j) LEFT JOIN m ON m.ix = i AND m.iy = j),
z AS (SELECT array_agg(g ORDER BY i) AS g, array_agg(u ORDER BY i) AS u FROM (SELECT i, array_agg(v IS NULL ORDER BY j) AS g, array_agg(coalesce(v, zonal, 0) ORDER BY j) AS u FROM (SELECT *, avg(v) OVER (PARTITION BY j) AS zonal FROM r) GROUP BY i))"""
_TILED_LAPLACE = f"""WITH RECURSIVE {_FIELD}, s AS (SELECT 0 AS n, g, u FROM z UNION ALL
SELECT n + 1, g, list_transform(u, lambda row, i: list_transform(row, lambda x, j: CASE WHEN g[i][j] THEN (u[CASE WHEN i = 1 THEN 2 ELSE i - 1 END][j] + u[CASE WHEN i = 64 THEN 63 ELSE i + 1 END][j] + u[i][CASE WHEN j = 1 THEN 2 ELSE j - 1 END] + u[i][CASE WHEN j = 64 THEN 63 ELSE j + 1 END]) / 4 ELSE x END)) FROM s WHERE n < 400)
{_table_sql("SELECT u FROM s WHERE n = 400", 4)}"""
_TILED_PASS = f"""WITH RECURSIVE {_FIELD}, c AS (SELECT p, q, (1 + 2 * list_sum(list_transform(range(1, 64), lambda k: exp(-k * k / (2 * 9.0 * 9.0)) * cos(pi() * k * (p + 0.5) / 64) * cos(pi() * k * (q + 0.5) / 64)))) / 64 AS w FROM range(64) a(p), range(64) b(q)),
low AS MATERIALIZED (SELECT array_agg(row ORDER BY p) AS k FROM (SELECT p, array_agg(w ORDER BY q) AS row FROM c GROUP BY p)),
s AS (SELECT 0 AS n, 1e9::DOUBLE AS rest, g, u FROM z UNION ALL
SELECT n + 1, list_max(list_transform(range(1, 65), lambda i: list_max(list_transform(range(1, 65), lambda j: CASE WHEN g[i][j] THEN abs(w[i][j] - u[i][j]) ELSE 0 END)))), g,
list_transform(u, lambda row, i: list_transform(row, lambda x, j: CASE WHEN g[i][j] THEN w[i][j] ELSE x END))
FROM (SELECT n, g, u, list_transform(k, lambda a: list_transform(range(1, 65), lambda j: list_dot_product(a, t[j]))) AS w
FROM (SELECT n, g, u, k, list_transform(k, lambda c: list_transform(u, lambda row: list_dot_product(c, row))) AS t FROM s, low WHERE rest >= 20 AND n < 500)))
{_table_sql("SELECT u FROM s ORDER BY n DESC LIMIT 1", 4)}"""


def _wide_field(spark, sf_dir):
    """Highest prices on 64 x 64 cells, 64 tiles of 8 x 8, a fifth of them gaps."""
    d = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 64 as ix", "(l_suppkey * 7 + l_linenumber * 5) % 64 as iy", "l_extendedprice as p").groupBy("ix", "iy").agg(F.max("p").alias("a"))
    return d.select("ix", "iy", F.when((F.col("ix") * 7 + F.col("iy") * 3) % 5 != 0, F.col("a")).alias("v"))


def _in_tiles(name, **options):
    def q(spark, sf_dir):
        return tiles.solve(_wide_field(spark, sf_dir), "v", name, **options).select("ix", "iy", F.round("filled", 4).alias("filled"))

    q.__name__ = f"fill_tiles_{name}"
    return q


for _name, _options, _sql in (("gauss_seidel", {"tile": 8, "epsilon": 1e-10, "sweeps": 4}, _TILED_LAPLACE), ("multigrid", {"tile": 8, "epsilon": 1e-10, "coarse": 1024}, _TILED_LAPLACE), ("fft_inpaint", {"tile": 8, "sigma": 9.0, "epsilon": 20.0}, _TILED_PASS)):
    register(_sql)(_in_tiles(_name, **_options))
