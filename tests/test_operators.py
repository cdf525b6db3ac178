"""Operators against numpy, closed forms and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geodesy, geohash
from tessera.operators import fill, geometry, grid, kernels, knn, planar, satellite, scattered, stats, windowed
from tessera.operators.axis import Axis
from tessera.sources import columns


def test_axis_metadata_and_errors():
    a = Axis((0.0, 1.0, 2.0, 3.0))
    assert a.is_regular() and a.increment() == 1.0 and len(a.flip()) == 4 and not a.flip().is_ascending()
    with pytest.raises(ValueError):
        Axis((0.0, 0.0))
    with pytest.raises(ValueError):
        Axis((0.0, 1.0, 5.0)).increment()
    assert Axis.linspace(0, 10, 36, 360.0).is_periodic() and not Axis.linspace(0, 10, 30, 360.0).is_periodic()
    assert Axis((0.0, 1.0), 360.0) != Axis((0.0, 1.0))


def test_axis_lookup_edges(spark):
    a, d = Axis.linspace(0, 1, 5), Axis((4.0, 3.0, 1.0, 0.0))
    df = spark.createDataFrame([(x,) for x in (None, float("nan"), -0.6, -0.4, 0.5, 4.0, 9.0)], "x double")
    got = df.select(a.find_index(F.col("x")), a.find_index(F.col("x"), True), a.find_indexes(F.col("x"))["i0"], d.find_indexes(F.col("x"))["i0"]).collect()
    assert [tuple(r) for r in got] == [(-1, -1, None, None), (-1, -1, None, None), (-1, 0, None, None), (0, 0, None, None), (1, 1, 0, 2), (4, 4, 3, 0), (-1, 4, None, None)]


def test_large_uneven_axis(spark):
    v = np.cumsum(np.random.default_rng(0).uniform(0.1, 2, 300))
    a = Axis(tuple(v))
    x = np.random.default_rng(1).uniform(v[0], v[-1], 200)
    got = [r[0] for r in spark.createDataFrame([(float(c),) for c in x], "x double").select(a.find_index(F.col("x"))).collect()]
    assert got == [int(np.abs(v - c).argmin()) for c in x]


@pytest.mark.parametrize("method", sorted(kernels.MINIMUM))
def test_kernels_interpolate_nodes_and_lines(method):
    rng = np.random.default_rng(2)
    xs = np.cumsum(rng.uniform(0.5, 1.5, (20, 7)), 1)
    ys = 3 * xs + 1
    x = xs[:, 2] + 0.3 * (xs[:, 3] - xs[:, 2])
    if "periodic" not in method:
        v, d = kernels.univariate(xs, ys, x, method)
        assert np.allclose(v, 3 * x + 1) and np.allclose(d, 3)
        v2, _ = kernels.univariate(xs[:, ::-1], ys[:, ::-1], x, method)
        assert np.allclose(v, v2)
    w = rng.normal(size=(20, 7))
    w[:, -1] = w[:, 0]
    for k in range(7):
        assert np.allclose(kernels.univariate(xs, w, xs[:, k], method)[0], w[:, k])
    w[0, 3] = np.nan
    assert np.isnan(kernels.univariate(xs, w, x, method)[0][0])
    assert np.isnan(kernels.univariate(xs, w, xs[:, -1] + 1, method)[0]).all()


def test_spline_has_continuous_derivative():
    xs = np.arange(8.0)[None]
    ys = np.sin(xs)
    for m in ("c_spline", "c_spline_not_a_knot", "akima", "steffen"):
        a = kernels.univariate(xs, ys, np.array([3 - 1e-7]), m)[1]
        b = kernels.univariate(xs, ys, np.array([3 + 1e-7]), m)[1]
        assert np.allclose(a, b, atol=1e-5)
    assert np.allclose(kernels.univariate(np.arange(6.0)[None], (np.arange(6.0) ** 3)[None], np.array([2.4]), "c_spline_not_a_knot")[0], 2.4**3)


def test_windowed_surface(spark):
    ax, ay = Axis.linspace(0, 1, 12), Axis.linspace(0, 1, 12)
    cells = spark.range(144).selectExpr("id div 12 as i", "id % 12 as j").withColumn("v", F.sin(F.col("i") / 3.0) * F.cos(F.col("j") / 3.0))
    g = grid.Grid.from_cells([ax, ay], cells, ["i", "j"], "v")
    p = spark.createDataFrame([(0, 5.3, 6.1), (1, 0.2, 5.0), (2, 4.0, 4.0)], "id int, x double, y double")
    for m in ("bicubic", "akima", "polynomial", "steffen"):
        got = {r.id: r.value for r in windowed.interpolate(g, p, "id", ["x", "y"], m).collect()}
        assert got[0] == pytest.approx(math.sin(5.3 / 3) * math.cos(6.1 / 3), abs=0.02) and got[1] is None
        assert got[2] == pytest.approx(math.sin(4 / 3) * math.cos(4 / 3), abs=1e-9)
    with pytest.raises(ValueError):
        windowed.interpolate(g, p, "id", ["x", "y"], "idw")


def test_periodic_seam(spark):
    ax, ay = Axis.linspace(0, 30, 12, 360.0), Axis.linspace(-90, 30, 7)
    cells = spark.range(84).selectExpr("id div 7 as i", "id % 7 as j").withColumn("v", F.cos(F.radians(F.col("i") * 30)))
    g = grid.Grid.from_cells([ax, ay], cells, ["i", "j"], "v")
    p = spark.createDataFrame([(0, 345.0, 10.0), (1, -15.0, 10.0), (2, 705.0, 10.0)], "id int, x double, y double")
    want = (math.cos(math.radians(330)) + 1) / 2
    assert all(r.value == pytest.approx(want) for r in grid.interpolate(g, p, "id", ["x", "y"]).collect())
    spl = [r.value for r in windowed.interpolate(g, p, "id", ["x", "y"], "bicubic", half=2).collect()]
    assert all(v == pytest.approx(math.cos(math.radians(15)), abs=0.02) for v in spl)


def test_gaps_and_bounds(spark):
    ax = Axis.linspace(0, 1, 3)
    cells = spark.createDataFrame([(i, j, None if (i, j) == (1, 1) else float(i + j)) for i in range(3) for j in range(3)], "i int, j int, v double")
    g = grid.Grid.from_cells([ax, ax], cells, ["i", "j"], "v")
    p = spark.createDataFrame([(0, 0.5, 0.5), (1, 5.0, 0.0)], "id int, x double, y double")
    assert [r.value for r in grid.interpolate(g, p, "id", ["x", "y"]).orderBy("id").collect()] == [None, None]
    with pytest.raises(Exception, match="outside the grid"):
        grid.interpolate(g, p, "id", ["x", "y"], bounds_error=True).collect()
    arr = spark.createDataFrame([([[0.0, 1.0, 2.0]] * 3,)], "a array<array<double>>")
    assert grid.Grid.from_arrays([ax, ax], arr, "a").cells.count() == 9


def test_knn_is_exact(spark):
    rng = np.random.default_rng(3)
    o = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) * 0.01])
    q = np.concatenate([rng.normal(size=(20, 3)), [[9, 9, 9]]])
    od = spark.createDataFrame([(i, *map(float, r), float(i)) for i, r in enumerate(o)], "oid int, x double, y double, z double, value double")
    qd = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "qid int, x double, y double, z double")
    got = knn.knn_join(qd, od, ["x", "y", "z"], 5).collect()
    d = np.sqrt(((q[:, None] - o) ** 2).sum(2))
    for i in range(len(q)):
        mine = sorted((r.rank, r.oid) for r in got if r.qid == i)
        assert [m[1] for m in mine] == np.argsort(d[i], kind="stable")[:5].tolist()
    near = knn.radius_join(qd, od, ["x", "y", "z"], 0.7).count()
    assert near == int((d <= 0.7).sum())


def test_solvers_reproduce_observations(spark):
    rng = np.random.default_rng(4)
    o = rng.uniform(size=(30, 3))
    od = spark.createDataFrame([(i, *map(float, r), float(r.sum()), 1e-9) for i, r in enumerate(o)], "oid int, x double, y double, z double, value double, sigma2 double")
    qd = od.select(F.col("oid").alias("qid"), "x", "y", "z").limit(6)
    n = knn.knn_join(qd, od, ["x", "y", "z"], 8, carry=["value", "sigma2"]).join(od.select("oid", "x", "y", "z"), "oid")
    want = {i: float(o[i].sum()) for i in range(6)}
    for out in (scattered.radial_basis(n, qd, ["x", "y", "z"]), scattered.kriging(n, qd, ["x", "y", "z"]), scattered.kriging(n, qd, ["x", "y", "z"], "matern_52", drift="linear"), scattered.optimal_interpolation(n, qd, ["x", "y", "z"], [1.0, 1.0, 1.0], covariance="matern_12"), scattered.inverse_distance(n)):
        assert all(r.value == pytest.approx(want[r.qid], abs=1e-4) for r in out.collect())
    wide = qd.withColumn("lx", F.lit(1.0))
    a = scattered.optimal_interpolation(n, wide, ["x", "y", "z"], ["lx", 1.0, 1.0], covariance="matern_12").orderBy("qid").collect()
    assert a == scattered.optimal_interpolation(n, qd, ["x", "y", "z"], [1.0, 1.0, 1.0], covariance="matern_12").orderBy("qid").collect()
    plane = spark.createDataFrame([(99, 0.4, 0.5, 0.6)], "qid int, x double, y double, z double")
    m = knn.knn_join(plane, od, ["x", "y", "z"], 12, carry=["value"]).join(od.select("oid", "x", "y", "z"), "oid")
    assert scattered.kriging(m, plane, ["x", "y", "z"], drift="linear").first().value == pytest.approx(1.5, abs=1e-6)
    with pytest.raises(ValueError):
        scattered.window_mean(n, "gaussian")
    with pytest.raises(ValueError):
        scattered.kriging(n, qd, ["x"], sigma=-1.0)


def test_fill_solvers_agree_and_keep_known():
    rng = np.random.default_rng(5)
    x, y = np.meshgrid(np.arange(16), np.arange(12), indexing="ij")
    z = x + 2.0 * y
    gaps = z.copy()
    gaps[rng.uniform(size=z.shape) < 0.2] = np.nan
    a, _, ra = fill.solve_gauss_seidel(gaps.copy(), 20_000, 1e-10)
    b, _, rb = fill.solve_multigrid(gaps.copy(), 5_000, 1e-10)
    assert ra < 1e-9 and rb < 1e-9 and np.allclose(a, b, atol=1e-6)
    for u in (a, b, fill.solve_fft(gaps.copy(), sigma=2.0)[0], fill.solve_loess(gaps.copy(), 2, 2)[0]):
        assert np.allclose(u[~np.isnan(gaps)], z[~np.isnan(gaps)]) and np.isfinite(u).all()
    assert fill.solve_gauss_seidel(z)[1] == 0


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(50, 3, 500)
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(x)] + [(float("nan"), 0), (None, 1)], "x double, g int")
    r = stats.describe(df, "x").first()
    assert r["std"] == pytest.approx(x.std())
    assert r["count"] == 500 and r["mean"] == pytest.approx(x.mean()) and r["variance"] == pytest.approx(x.var())
    parts = stats.state(df, "x", ["g"])
    assert stats.merged(parts).first()["kurtosis"] == pytest.approx(r["kurtosis"])
    none = stats.describe(df.where("false"), "x").first()
    assert none["count"] == 0 and none["mean"] is None and none["sum"] == 0
    with pytest.raises(ValueError):
        stats.quantiles(df, "x", [1.5])


def test_geohash_known_codes(spark):
    df = spark.createDataFrame([(-5.60302734375, 42.60498046875), (180.0, 0.0), (-180.0, 0.0)], "x double, y double")
    got = [tuple(r) for r in df.select(geohash.encode(F.col("x"), F.col("y"), 5), geohash.string_to_int(geohash.encode(F.col("x"), F.col("y"), 12)) == geohash.encode_int(F.col("x"), F.col("y"), 12)).collect()]
    assert got[0] == ("ezs42", True) and got[1][0] == got[2][0]
    r = spark.createDataFrame([("ezs42",)], "h string").select(geohash.decode(F.col("h"), True).alias("c"), geohash.bounding_box(F.col("h")).alias("b")).first()
    assert r.b.lon0 <= r.c.lon <= r.b.lon1 and r.b.lat0 <= r.c.lat <= r.b.lat1
    assert geohash.zoom_in(spark.createDataFrame([("ez",)], "h string"), "h", 3).count() == 32
    with pytest.raises(ValueError):
        geohash.encode(F.lit(0.0), F.lit(0.0), 13)


def test_geodesic_values(spark):
    # Flinders Peak to Buninyong, the survey line of the published Vincenty example
    d, az = geodesy.vincenty_inverse(np.array([144.42486789]), np.array([-37.95103342]), np.array([143.92649553]), np.array([-37.65282114]), 6378137.0, 1 / 298.257222101, 6378137.0 * (1 - 1 / 298.257222101), 6371008.8)
    assert d[0] == pytest.approx(54972.271, abs=0.01) and math.degrees(az[0]) == pytest.approx(306.868159, abs=1e-4)
    w = geodesy.WGS84
    a = spark.range(1).select(w.andoyer(F.lit(2.0), F.lit(48.0), F.lit(10.0), F.lit(50.0))).first()[0]
    v = geodesy.vincenty_inverse(np.array([2.0]), np.array([48.0]), np.array([10.0]), np.array([50.0]), w.a, w.f, w.b, w.mean_radius)[0][0]
    assert a == pytest.approx(v, rel=1e-5)
    assert w.authalic_radius == pytest.approx(6371007.18, abs=0.05)


SQUARE = ("polygon", [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]])


def _box(x, y, w, h):
    return ("box", [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]])


def test_relations():
    assert planar.relation(SQUARE, SQUARE) == "2FFF1FFF2"
    assert planar.relation(SQUARE, _box(1, 1, 1, 1)) == "212FF1FF2"
    assert planar.relation(SQUARE, _box(4, 0, 2, 4)) == "FF2F11212"
    assert planar.relation(SQUARE, _box(9, 9, 1, 1)) == "FF2FF1212"
    a, b = ("linestring", [[[(0, 0), (2, 2)]]]), ("linestring", [[[(0, 2), (2, 0)]]])
    assert planar.relation(a, b) == "0F1FF0102" and planar.PREDICATES["crosses"](a, b)
    assert planar.PREDICATES["touches"](("point", [[[(0, 1)]]]), SQUARE) and not planar.PREDICATES["within"](("point", [[[(0, 1)]]]), SQUARE)


def test_overlay_and_editing():
    area = lambda g: sum(planar._ring_area(r) for m in g[1] for r in m)
    hole = planar.overlay(SQUARE, _box(1, 1, 2, 2), "difference")
    assert area(hole) == pytest.approx(12) and len(hole[1][0]) == 2
    assert area(planar.overlay(hole, _box(1, 1, 2, 2), "union")) == pytest.approx(16)
    assert area(planar.overlay(SQUARE, _box(2, 2, 4, 4), "intersection")) == pytest.approx(4)
    assert area(planar.buffer(("point", [[[(0, 0)]]]), 1.0, 360)) == pytest.approx(math.pi, rel=1e-3)
    assert area(planar.hull(("multipoint", [[[(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]]]))) == pytest.approx(4)
    assert planar.simplify(("linestring", [[[(0, 0), (1, 0.01), (2, 0)]]]), 0.1)[1][0][0] == [(0, 0), (2, 0)]
    assert planar.distance(SQUARE, _box(7, 8, 1, 1)) == pytest.approx(5)
    assert planar.invalid(SQUARE) == "" and planar.invalid(("polygon", [[[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]])) != ""
    assert not planar.is_simple(("linestring", [[[(0, 0), (2, 2), (2, 0), (0, 2)]]]))
    line = planar.overlay(("linestring", [[[(-1, 2), (5, 2)]]]), SQUARE, "intersection")
    assert line == ("multilinestring", [[[(0, 2), (4, 2)]]])


def test_wkt_round_trip(spark):
    texts = ["POINT(1 2)", "LINESTRING(0 0,1 1,2 0)", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT(1 2,3 4)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", geometry.from_wkt(F.col("t")))
    assert [r[0] for r in df.select(geometry.to_wkt(F.col("g"))).collect()] == texts
    back = df.withColumn("h", geometry.from_geojson(geometry.to_geojson(F.col("g"))))
    assert all(r[0] == r[1] for r in back.select("g.parts", "h.parts").collect())
    r = df.select(geometry.num_geometries(F.col("g")), geometry.num_points(F.col("g"))).collect()
    assert [tuple(x) for x in r] == [(1, 1), (1, 3), (1, 8), (2, 2), (2, 4), (2, 8)]


def test_line_tools(spark):
    pts = F.array(*[geometry.pt(F.lit(float(x)), F.lit(0.0)) for x in (0, 3, 10)])
    r = spark.range(1).select(geometry.line_interpolate(pts, F.lit(5.0)).alias("a"), geometry.line_interpolate(pts, F.lit(99.0)).alias("b"), geometry.num_points(geometry.densify(geometry.line(pts), 1.0)).alias("n"), geometry.length(geometry.line(pts)).alias("l")).first()
    assert (r.a.x, r.b.x, r.n, r.l) == (5.0, 10.0, 11, 10.0)


def test_orbit_resampling_follows_the_track(spark):
    from tessera.plans.queries_geometry import track

    t = track(spark, "/root/testdata/sf0.001").where("track = 0 and idx < 60")
    for r in satellite.interpolate_orbit(t, 500_000).collect():
        i = r.time / 1e6
        if 3 < i < 55:
            assert r.lon == pytest.approx(-60 + i * 0.05, abs=1e-4) and r.lat == pytest.approx(66 * math.sin(2 * math.pi * (i + 0.25) / 1500), abs=1e-4)
    sw = satellite.calculate_swath(t, ["track"], half_km=20.0)
    far = sw.join(t, ["track", "idx"]).select(F.abs("x_ac").alias("x"), (geodesy.haversine(F.col("lon"), F.col("lat"), F.col("swath_lon"), F.col("swath_lat")) / 1000).alias("d")).collect()
    assert all(r.d == pytest.approx(r.x, rel=0.02) for r in far)


def test_roles_and_ephemeris(spark, tmp_path):
    df = spark.createDataFrame([(float(x), float(y), x + 10.0 * y) for x in range(0, 360, 90) for y in range(3)], "a double, b double, v double")
    df = columns.with_units(df, a="degrees_east", b="degrees_north")
    g = columns.grid_from(df, "v", ["b", "a"], 2, True)
    for dims, size, geodetic in ((["a", "b"], 3, False), (["a", "a"], None, False), (["b"], None, True)):
        with pytest.raises(ValueError):
            columns.grid_from(df, "v", dims, size, geodetic)
    assert columns.role(df, "a") == "longitude" and len(g.axes[0]) == 4 and g.axes[0].is_periodic()
    (tmp_path / "e.txt").write_text("# c\n0 1.5 2.5 3\n 1  1.6 2.6 3\n")
    assert columns.ephemeris(spark, str(tmp_path / "e.txt")).count() == 2
    columns.save_state(stats.state(df, "v", ["b"]), str(tmp_path / "s"))
    assert stats.merged(columns.load_state(spark, str(tmp_path / "s"))).first()["count"] == 12


def test_stream(spark, tmp_path):
    from tessera.streaming import binning

    src = str(tmp_path / "in")
    spark.createDataFrame([(f"2024-01-01 0{h}:1{m}:00", float(h), float(m)) for h in range(4) for m in range(5)], "t string, x double, z double").selectExpr("cast(t as timestamp) ts", "x", "z").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, x double, z double").parquet(src)
    q = binning.binned(s, "ts", "x", "z", Axis.linspace(0, 1, 4)).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["ix"], r["count"], r["mean"]) for r in spark.table("bins").collect()) == [(h, 5, 2.0) for h in range(4)]


def test_index_and_geographic_neighbours(spark):
    rng = np.random.default_rng(7)
    o = [(i, float(x), float(y), float(i)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 120), rng.uniform(-89, 89, 120), strict=True))]
    q = [(0, 179.9, 10.0), (1, 0.0, 89.0), (2, -33.0, -20.0)]
    od, qd = spark.createDataFrame(o, "oid int, lon double, lat double, value double"), spark.createDataFrame(q, "qid int, lon double, lat double")
    r = geodesy.WGS84.mean_radius
    for row in knn.geographic_knn(qd, od, 3).collect():
        a, b = q[row.qid], o[row.oid]
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        assert row.distance == pytest.approx(2 * r * math.asin(math.sqrt(h)), rel=1e-9)
    index = knn.PointIndex(["lon", "lat"]).packing(od.limit(100)).insert(od.where("oid >= 100"))
    assert index.size() == 120 and index.query(qd, 4).count() == 12 and index.query_ball(qd, 1000.0).count() == 360
    index.clear()
    assert index.empty()


def test_thomas_agrees_with_vincenty(spark):
    w = geodesy.WGS84
    for x, y in ((10.0, 50.0), (-70.0, 5.0), (2.0, 48.0)):
        t = spark.range(1).select(w.thomas(F.lit(2.0), F.lit(48.0), F.lit(x), F.lit(y))).first()[0]
        v = geodesy.vincenty_inverse(np.array([2.0]), np.array([48.0]), np.array([x]), np.array([y]), w.a, w.f, w.b, w.mean_radius)[0][0]
        assert t == pytest.approx(v, abs=0.5)


def test_interpolator_checks_options(spark):
    ax = Axis.linspace(0, 1, 8)
    cells = spark.range(64).selectExpr("id div 8 as i", "id % 8 as j", "cast(id as double) as v")
    f = windowed.RegularGridInterpolator(grid.Grid.from_cells([ax, ax], cells, ["i", "j"], "v"))
    p = spark.createDataFrame([(0, 3.5, 3.5)], "id int, x double, y double")
    assert f(p, "id", ["x", "y"]).first().value == pytest.approx(31.5) and f(p, "id", ["x", "y"], "bicubic").first().value == pytest.approx(31.5)
    with pytest.raises(TypeError):
        f(p, "id", ["x", "y"], "idw", half=2)
    with pytest.raises(TypeError):
        f(p, "id", ["x", "y"], "akima", exponent=2)
