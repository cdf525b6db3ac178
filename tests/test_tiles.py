"""Solvers in tiles against those of one task, and geodesics against an integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geodesic
from tessera.functions.geodesy import WGS84
from tessera.operators import fill, tiles
from tessera.operators import geometry as g
from tessera.session import ship


@pytest.fixture(scope="module")
def fields(spark):
    ship(spark)
    rng, out, rows = np.random.default_rng(2), {}, []
    for k, (nx, ny) in enumerate([(37, 50), (20, 33), (5, 9), (6, 4)]):
        z = np.cumsum(rng.standard_normal((nx, ny)), 1)
        if k < 3:
            z[rng.random((nx, ny)) < 0.35] = np.nan
            z[5:15, 3:9] = np.nan
        out[k] = z
        rows += [(k, i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(nx) for j in range(ny) if (i, j) != (1, 1) or k]
    out[0][1, 1] = np.nan  # a cell without a row
    return out, spark.createDataFrame(rows, "g int, ix int, iy int, v double").withColumns({"u": F.lit(1), "k": F.lit("x"), "gap": F.lit(2)})


@pytest.mark.parametrize(
    ("name", "shared", "own"),
    [
        ("gauss_seidel", {"epsilon": 1e-3}, {"tile": 16, "sweeps": 7}),
        ("gauss_seidel", {"epsilon": 1e-3, "is_periodic": True, "iterations": 21, "guess": "global"}, {"tile": 16}),
        ("fft_inpaint", {"sigma": 6.0, "epsilon": 0.05, "iterations": 4}, {"tile": 8}),
        ("fft_inpaint", {"sigma": 6.0, "epsilon": 0.05, "is_periodic": True, "iterations": 3}, {"tile": 16}),
        ("multigrid", {"epsilon": 1e-2, "iterations": 3}, {"tile": 16, "coarse": 600}),
    ],
)
def test_tiles_give_what_one_task_gives(fields, name, shared, own):
    want, d = fields
    got = tiles.solve(d, "v", name, ["g"], **shared, **own).toPandas()
    assert len(got) == d.count()
    for k, z in want.items():
        u, n, r = fill.SOLVERS[name](z.copy(), **shared)
        mine = got[got.g == k]
        assert np.abs(u[mine.ix, mine.iy] - mine.filled).max() < 1e-12 and set(mine.iterations) == {n} and np.allclose(mine.residual, r)


def test_odd_fields_in_tiles(spark):
    d = spark.createDataFrame([(None, 0, 0, 1.0), (None, 0, 2, None), (None, 0, 2, float("nan")), (1, 3, 1, None), (2, -1, 0, 5.0), (2, None, 0, 5.0)], "g int, ix int, iy int, v double")
    got = {(r.g, r.ix, r.iy): r.filled for r in tiles.solve(d, "v", "gauss_seidel", ["g"], tile=4, guess="zero", iterations=500, epsilon=1e-9).collect()}
    assert set(got) == {(None, 0, 0), (None, 0, 2), (1, 3, 1)} and abs(got[None, 0, 2] - 1) < 1e-6 and got[1, 3, 1] == 0
    assert tiles.solve(d.limit(0), "v", "multigrid", ["g"]).count() == 0
    for bad in ({"tile": 6}, {"guess": "best"}):
        with pytest.raises(ValueError):
            tiles.solve(d, "v", "gauss_seidel", ["g"], **bad)


# geodesics


def followed(lon, lat, azimuth, s, steps=3000):
    """The end of a geodesic by a Runge-Kutta integration in space, of a curve whose acceleration stands
    upright on the spheroid."""
    e, x, y, z = WGS84, *(np.radians(v) for v in (lon, lat, azimuth))
    p = place(lon, lat)
    v = np.stack([-np.sin(x), np.cos(x), 0 * x]) * np.sin(z) + np.stack([-np.sin(y) * np.cos(x), -np.sin(y) * np.sin(x), np.cos(y)]) * np.cos(z)
    w = np.array([e.a**-2, e.a**-2, e.b**-2])[:, None]
    pull = lambda p, v: -((w * v * v).sum(0) / ((w * p) ** 2).sum(0)) * (w * p)
    h = s / steps
    for _ in range(steps):
        a = pull(p, v)
        b = pull(p + h / 2 * v, v + h / 2 * a)
        c = pull(p + h / 2 * v + h * h / 4 * a, v + h / 2 * b)
        d = pull(p + h * v + h * h / 2 * b, v + h * c)
        p, v = p + h * v + h * h / 6 * (a + b + c), v + h / 6 * (a + 2 * b + 2 * c + d)
    return p


def place(lon, lat):
    x, y = np.radians(lon), np.radians(lat)
    n = WGS84.a / np.sqrt(1 - WGS84.e2 * np.sin(y) ** 2)
    return np.stack([n * np.cos(y) * np.cos(x), n * np.cos(y) * np.sin(x), n * (1 - WGS84.e2) * np.sin(y)])


def test_geodesics_end_where_they_should():
    rng = np.random.default_rng(48)
    m = 60
    lon, lat = rng.uniform(-180, 180, m), rng.uniform(-80, 80, m)
    ends = [
        (lon, lat, rng.uniform(-180, 180, m), rng.uniform(-90, 90, m)),
        (lon, lat, lon + 180 + rng.uniform(-0.6, 0.6, m), -lat + rng.uniform(-0.6, 0.6, m)),
        (lon, lat, lon + 180, -lat),
        (lon, 0 * lat, lon + rng.uniform(150, 210, m), 0 * lat),
        (lon, lat, lon, rng.uniform(-90, 90, m)),
        (lon, lat, lon + rng.uniform(-179, 179, m), lat),
        (lon, 0 * lat + 90, rng.uniform(-180, 180, m), lat),
    ]
    for x1, y1, x2, y2 in ends:
        d, az, _ = geodesic.inverse_arrays(x1, y1, x2, y2)
        assert np.sqrt(((followed(x1, y1, az, d) - place(x2, y2)) ** 2).sum(0)).max() < 2e-6
        back, _, away = geodesic.inverse_arrays(x2, y2, x1, y1)
        assert np.abs(back - d).max() < 1e-6
    d, a, b = geodesic.inverse_arrays([0.0, np.nan, 0.0], [0.0, 1.0, 95.0], [0.0, 1.0, 1.0], [0.0, 1.0, 1.0])
    assert d[0] == 0 and np.isnan(d[1:]).all() and np.isnan(a[1:]).all()


def test_areas_of_geodesic_rings(spark):
    ship(spark)
    whole = 4 * math.pi * WGS84.authalic_radius**2
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in (*ps, ps[0])]
    dense = [(x, 20) for x in np.linspace(0, 10, 2001)] + [(x, 30) for x in np.linspace(10, 0, 2001)]
    e = math.sqrt(WGS84.e2)
    q = lambda y: (1 - e * e) * (math.sin(y) / (1 - (e * math.sin(y)) ** 2) + math.atanh(e * math.sin(y)) / e)
    zone = WGS84.a**2 / 2 * math.radians(10) * (q(math.radians(30)) - q(math.radians(20)))
    rings = [ring((0, 0), (90, 0), (90, 90), (0, 90)), ring((0, 0), (90, 0), (0, 90)), ring((0, 0), (90, 0), (180, 0), (-90, 0)), ring(*dense), ring((170, -10), (-170, -10), (-170, 10), (170, 10)), ring((-10, -10), (10, -10), (10, 10), (-10, 10)), ring((0, 80), (120, 80), (-120, 80))]
    d = spark.createDataFrame([(k, r) for k, r in enumerate(rings)] + [(99, None)], "k int, r array<struct<x:double,y:double>>")
    p = g.polygon(F.col("r"))
    got = {r.k: r for r in d.select("k", g.geodetic_area(p, strategy="karney").alias("area"), g.perimeter(p, "karney").alias("around"), g.length(g.line(F.col("r")), "karney").alias("length")).collect()}
    assert abs(got[0].area / whole * 8 - 1) < 1e-12 and abs(got[1].area / whole * 8 - 1) < 1e-12 and abs(got[2].area / whole * 2 - 1) < 1e-12
    assert abs(got[3].area / zone - 1) < 1e-8 and abs(got[4].area / got[5].area - 1) < 1e-12 and got[4].around == got[4].length
    cap = WGS84.a**2 * math.pi * (q(math.pi / 2) - q(math.radians(80)))
    assert 0.3 < got[6].area / cap < 0.8  # a triangle around the pole
