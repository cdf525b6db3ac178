"""Digests, hulls, buffers, long axes, lists without keys: defined cases and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geodesy
from tessera.operators import digest, grid, knn, period, planar, satellite, scattered, stats, windowed
from tessera.operators.axis import Axis, TemporalAxis


def test_digest_quantiles():
    rng = np.random.default_rng(1)
    x, w = rng.lognormal(size=20_000), rng.integers(1, 5, 20_000).astype(float)
    parts = [digest.compress(a, b, 200) for a, b in zip(np.array_split(x, 7), np.array_split(w, 7), strict=True)]
    m, k = digest.compress(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), 200)
    assert len(m) <= 202 and k.sum() == pytest.approx(w.sum()) and (np.diff(m) >= 0).all()
    qs = np.array([0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999])
    got = digest.estimate(m, k, x.min(), x.max(), qs)
    rank = [w[x <= g].sum() / w.sum() for g in got]
    assert np.abs(np.array(rank) - qs).max() < 0.005 and abs(rank[0] - 0.001) < 0.0005
    assert np.isnan(digest.estimate(*digest.compress(np.array([]), np.array([]), 5), None, None, [0.5])).all()


def test_digest_rows(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", float("nan"), 1.0), ("a", None, 1.0), ("b", 5.0, -1.0), (None, 7.0, 2.0), ("a", 3.0, None)], "g string, x double, w double")
    got = {r.g: r for r in digest.build(d, "x", ["g"], "w").select("g", "count", "weight", *digest.quantile_columns([0.5])).collect()}
    assert (got["a"].count, got["a"].q50, got["b"].count, got["b"].q50, got[None].q50) == (got["a"].count, 1.0, got["b"].count, None, 7.0)
    assert got["a"]["count"] == 1 and got["b"]["count"] == 0 and got[None]["weight"] == 2.0
    one = digest.build(d, "x").select("count", "min", "max").first()
    assert (one["count"], one["min"], one["max"]) == (4, 1.0, 7.0)
    assert digest.build(d.limit(0), "x", ["g"]).count() == 0
    with pytest.raises(ValueError):
        digest.build(d, "x", compression=0)
    with pytest.raises(ValueError):
        digest.quantile_columns([2.0])


def test_moments_of_a_small_spread(spark):
    rng = np.random.default_rng(2)
    x = 1e6 + rng.standard_normal(4000)
    d = spark.createDataFrame([(float(v), i % 5, float(i % 3)) for i, v in enumerate(x)], "x double, g int, w double")
    c = x - x.mean()
    want = (c @ c / len(x), (c**3).mean() / (c @ c / len(x)) ** 1.5, (c**4).mean() / (c @ c / len(x)) ** 2 - 3)
    for r in (stats.describe(d, "x").first(), stats.merged(stats.state(d, "x", ["g"])).first()):
        assert (r["variance"], r["skewness"], r["kurtosis"]) == pytest.approx(want, abs=1e-6)
    w = np.arange(len(x)) % 3
    mean = (w * x).sum() / w.sum()
    r = stats.describe(d, "x", weight="w").first()
    assert r["mean"] == pytest.approx(mean, abs=1e-9) and r["variance"] == pytest.approx((w * (x - mean) ** 2).sum() / w.sum())
    same = stats.describe(d.select(F.lit(5.0).alias("x")), "x").first()
    assert same["variance"] == 0 and same["kurtosis"] is None


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_hull(dim):
    rng = np.random.default_rng(dim)
    for _ in range(60):
        p = rng.standard_normal((7, dim))
        inside = rng.dirichlet(np.ones(7)) @ p
        assert knn.in_hull(p, inside)
        far = p.mean(0) + 10 * rng.standard_normal(dim) / 3
        way = (far - p.mean(0)) / max(np.linalg.norm(far - p.mean(0)), 1e-9)
        assert not knn.in_hull(p, p.mean(0) + way * ((p - p.mean(0)) @ way).max() + way * 0.1)
    flat = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]])[:, :dim]
    if dim == 3:
        assert knn.in_hull(flat, np.array([0.2, 0.2, 0])) and not knn.in_hull(flat, np.array([0.2, 0.2, 0.1]))
    assert knn.in_hull(np.zeros((2, dim)), np.zeros(dim)) and not knn.in_hull(np.zeros((2, dim)), np.ones(dim))


def test_neighbours_of_crowded_data(spark):
    """A dense crowd and a few points far away, against brute force."""
    rng = np.random.default_rng(3)
    o = np.concatenate([rng.standard_normal((3000, 2)) * 1e-4, rng.uniform(-100, 100, (40, 2))])
    q = np.concatenate([rng.standard_normal((20, 2)) * 1e-4, rng.uniform(-100, 100, (10, 2))])
    obs = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(o)], "oid long, x double, y double")
    qs = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "qid long, x double, y double")
    got = {}
    for r in knn.knn_join(qs, obs, ["x", "y"], 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.oid))
    for i, p in enumerate(q):
        want = np.lexsort((np.arange(len(o)), np.hypot(*(o - p).T)))[:3]
        assert [x for _, x in sorted(got[i])] == want.tolist()
    with pytest.raises(ValueError):
        knn.knn_join(qs, obs, ["x", "y", "x", "y"], 3, boundary="convex_hull")
    with pytest.raises(ValueError):
        knn.knn_join(qs, obs, ["x", "y"], 3, boundary="circle")


def test_neighbours_of_copies(spark, monkeypatch):
    """Many observations and queries at few places: against brute force, and few pairs are made."""
    places = [(0.0, 0.0), (0.25, 0.5), (3.0, 1.0), (8.0, 8.0)]
    obs = spark.range(4000).selectExpr("3999 - id as oid", f"element_at(array{tuple(p[0] for p in places)}, int(id % 4) + 1) * 1D as x", f"element_at(array{tuple(p[1] for p in places)}, int(id % 4) + 1) * 1D as y", "double(id) as value")
    qs = spark.range(500).selectExpr("id as qid", "double(id % 5) as x", "double(id % 3) as y").union(spark.createDataFrame([(500, None, 1.0)], "qid long, x double, y double"))
    made, pairs = [], knn._candidates
    monkeypatch.setattr(knn, "_candidates", lambda *a: made.append(pairs(*a)) or made[-1])
    got = {}
    for r in knn.knn_join(qs, obs, ["x", "y"], 3, carry=["value"]).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.oid, r.distance, r.value))
    assert sum(m.count() for m in made) < 5000
    o = np.array([r[:3] for r in obs.select("oid", "x", "y").collect()])
    assert sorted(got) == list(range(500))
    for i, found in got.items():
        d = np.hypot(o[:, 1] - i % 5, o[:, 2] - i % 3)
        want = np.lexsort((o[:, 0], d))[:3]
        assert [(x[1], x[2], x[3]) for x in sorted(found)] == [(o[j, 0], pytest.approx(d[j]), 3999 - o[j, 0]) for j in want]


def test_radius_totals_of_copies(spark, monkeypatch):
    obs = spark.range(3000).selectExpr("id as oid", "double(id % 6) as x", "double(id % 4) as y")
    qs = spark.range(200).selectExpr("id as qid", "double(id % 2) as x", "0.5D as y").union(spark.createDataFrame([(200, 900.0, 0.0)], "qid long, x double, y double"))
    want = {r.qid: (r.n, r.total) for r in knn.radius_join(qs, obs, ["x", "y"], 1.5).groupBy("qid").agg(F.count("*").alias("n"), F.sum("distance").alias("total")).collect()}
    made, pairs = [], knn._candidates
    monkeypatch.setattr(knn, "_candidates", lambda *a: made.append(pairs(*a)) or made[-1])
    got = {r.qid: (r.n, pytest.approx(r.total)) for r in knn.radius_totals(qs, obs, ["x", "y"], 1.5).collect()}
    assert want == got and len(got) == 200 and sum(m.count() for m in made) <= 24


def test_facets_of_flat_neighbours(spark):
    """Neighbours in one place part no query from themselves, those on a line only what is beside it."""
    assert knn.in_hull(np.zeros((3, 2)), np.ones(2), spanned=False)
    line = np.array([[0.0, 0], [1, 1], [2, 2]])
    assert knn.in_hull(line, np.array([9.0, 9]), spanned=False) and not knn.in_hull(line, np.array([1.0, 1.5]), spanned=False)
    rng = np.random.default_rng(4)
    for _ in range(200):
        p, q = rng.integers(0, 5, (6, 2)).astype(float), rng.integers(0, 5, 2).astype(float)
        if np.linalg.matrix_rank(p - p[0]) == 2:
            assert knn.in_hull(p, q) == knn.in_hull(p, q, spanned=False)
    obs = spark.range(20).selectExpr("id as oid", "1D as x", "1D as y")
    qs = spark.createDataFrame([(1, 0.0, 0.0)], "qid long, x double, y double")
    assert knn.knn_join(qs, obs, ["x", "y"], 3, boundary="facets").count() == 3
    assert knn.knn_join(qs, obs, ["x", "y"], 3, boundary="convex_hull").count() == 0


def test_sinc_at_zero(spark, tmp_path):
    """The helper gives the limit, the query the quotient of its SQL."""
    import math

    from tessera.functions import mathx
    from tessera.plans import registry

    assert spark.range(1).select(mathx.sinc(F.lit(0.0)).alias("s")).first().s == 1
    spark.createDataFrame([(1, 250.0), (2, 250.5)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.sinc for r in registry.QUERIES["math_helpers"](spark, str(tmp_path)).collect()}
    assert math.isnan(got[1]) and got[2] == pytest.approx(2 / math.pi)


def test_buffers():
    area = lambda g: sum(planar._ring_area(r) for m in g[1] for r in m)
    square = ("polygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]])
    assert area(planar.buffer(square, 1.0, join="miter")) == pytest.approx(36)
    assert area(planar.buffer(square, 1.0, join="miter", limit=1.0)) == pytest.approx(36 - 4 * 0.5)
    assert area(planar.buffer(square, -1.0)) == pytest.approx(4)
    line = ("linestring", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]]])
    assert area(planar.buffer(line, 1.0, end="flat", join="miter")) == pytest.approx(16)
    assert area(planar.buffer(line, 1.0, end="flat", join="miter", right=2.0)) == pytest.approx(4 * 3 + 4 * 3 + 4 - 1)
    assert area(planar.buffer(("point", [[[(1.0, 1.0)]]]), 2.0, point="square")) == pytest.approx(16)


def test_nearest_on_the_sphere():
    p, q = planar.closest_on_sphere(("point", [[[(10.0, 0.0)]]]), ("linestring", [[[(0.0, -40.0), (0.0, 40.0)]]]))
    assert p == (10.0, 0.0) and q == pytest.approx((0.0, 0.0), abs=1e-9)
    box = ("polygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]])
    a, b = planar.closest_on_sphere(box, ("point", [[[(2.0, 2.0)]]]))
    assert a == b == (2.0, 2.0)


def test_long_uneven_axis(spark):
    values = np.cumsum(np.random.default_rng(4).uniform(0.5, 1.5, 500))
    axis = Axis(tuple(values.tolist()))
    x = np.random.default_rng(5).uniform(-2, values[-1] + 2, 300)
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    for r in d.select("x", axis.find_index(F.col("x")).alias("i"), axis.find_indexes(F.col("x")).alias("b"), axis.coordinate(axis.find_index(F.col("x"), True)).alias("c")).collect():
        inside = values[0] <= r.x <= values[-1]
        assert r.i == (np.abs(values - r.x).argmin() if inside else -1)
        assert (r.b is None) == (not inside) and (r.b is None or values[r.b.i0] <= r.x <= values[r.b.i1])
        assert r.c == values[np.abs(values - r.x).argmin()]
    for boundary in ("undef", "shrink", "expand", "sym", "wrap"):
        ids, ok = axis.windows(np.arange(499), 3, boundary)
        rows = spark.range(499).select(axis.window_at(F.col("id"), 3, boundary).alias("w")).collect()
        assert all((r.w or []) == i[k].tolist() for r, i, k in zip(rows, ids, ok, strict=True))


def test_temporal_axis_units():
    with pytest.raises(ValueError):
        TemporalAxis.from_range(1, 10, 3, "s")
    assert TemporalAxis.from_range(0, 1_000_000, 3, "s").dtype == "timestamp[s]" and TemporalAxis.from_range(0, 1, 3).dtype == "timestamp[us]"


def test_one_long_list(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(b, b + rng.randint(0, 30)) for b in (rng.randint(0, 4000) for _ in range(300))]
    d = spark.createDataFrame(rows, "begin long, last long")
    want, end = [], None
    for b, e in sorted(rows):
        if end is not None and b <= end + 1 + 2:
            end = max(end, e)
            want[-1] = (want[-1][0], end)
        else:
            want.append((b, e))
            end = e
    for slots in (1, 7, 1000):
        monkeypatch.setattr(period, "SLOTS", slots)
        merged = period.islands(d, gap=2)
        assert sorted((r.begin, r.last) for r in merged.collect()) == want
        pts = spark.range(-5, 4100, 13).select(F.col("id").alias("t"))
        for r in period.find_containing(pts, "t", merged).collect():
            assert (r.p_begin, r.p_last) == next(((b, e) for b, e in want if b <= r.t <= e), (None, None))


def test_windowed_edges_and_points_of_one_id(spark):
    axis = Axis.linspace(0.0, 1.0, 8)
    cells = spark.range(8).select(F.col("id").alias("i0"), (F.col("id") * 2.0).alias("v"))
    g1 = grid.Grid.from_cells([axis], cells, ["i0"], "v")
    p = spark.createDataFrame([(1, 0.5), (1, 3.5), (2, 7.0), (3, 9.0), (4, None), (5, float("nan"))], "id long, x double")
    rows = sorted((r.id, r.value) for r in windowed.interpolate(g1, p, "id", ["x"], "linear", half=2, boundary="shrink").collect() if r.value is not None)
    assert rows == [(1, 1.0), (1, 7.0), (2, 14.0)]
    assert windowed.interpolate(g1, p, "id", ["x"], "linear", half=2).where("value is null").count() == 5
    with pytest.raises(ValueError):
        windowed.interpolate(g1, p, "id", ["x"], "linear", boundary="none")
    with pytest.raises(Exception, match="outside"):
        windowed.interpolate(g1, p, "id", ["x"], "linear", boundary="shrink", bounds_error=True).collect()


def test_window_supports(spark):
    d = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.5, 3.0), (1, 5.0, 7.0)], "qid long, distance double, value double")
    lanczos = {r.qid: r for r in scattered.window_mean(d, "lanczos", 1.0, 2.0).collect()}
    x = 1.5
    w = np.sinc(x) * np.sinc(x / 2)
    assert lanczos[0].value == pytest.approx((1 + 3 * w) / (1 + w)) and (lanczos[1].value, lanczos[1].neighbours) == (None, 0)
    parzen = {r.qid: r for r in scattered.window_mean(d, "parzen", 1.0, 2.0).collect()}
    assert parzen[0].value == pytest.approx((1 + 3 * 2 * (1 - 1.5) ** 3) / (1 + 2 * (1 - 1.5) ** 3))
    assert {r.qid: r.value for r in scattered.window_mean(d, "boxcar", 1.0).collect()}[0] == 1.0


def test_swath_is_compiled(spark):
    """Its pixels are plain columns, without lambdas that are interpreted, and those of the struct's closed form."""
    ball = geodesy.WGS84
    p = spark.range(2000).selectExpr("id", "(id * 37 % 3600) / 10D - 180 as a", "(id * 53 % 1800) / 10D - 90 as b", "(id % 7) * 1000D as h")
    p = p.withColumn("e", ball.lla_to_ecef(F.col("a"), F.col("b"), F.col("h"))).select("id", "a", "b", "e.x", "e.y", "e.z")
    both = ball.with_lla(p.withColumn("s", ball.ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))), "x", "y", "z").select("a", "b", "lon", "lat", "s.*").toDF("a", "b", "lon", "lat", "lon0", "lat0", "alt0").collect()
    assert len(both) == 2000 and all((r.lon, r.lat) == (r.lon0, r.lat0) and r.lat == pytest.approx(r.b, abs=1e-9) for r in both)
    t = spark.range(30).selectExpr("id div 10 as track", "id % 10 as idx", "(id % 10) * 0.05D as lon", "(id % 10) * 0.3D + id div 10 as lat")
    sw = satellite.calculate_swath(t, ["track"])
    assert sw.count() == 30 * 70 and "lambda" not in sw._jdf.queryExecution().executedPlan().toString()
    one = sw.where("track = 0 and idx = 5").orderBy("x_ac").collect()
    far = [geodesy.haversine(F.lit(0.25), F.lit(1.5), F.lit(r.swath_lon), F.lit(r.swath_lat)).alias(f"d{i}") for i, r in enumerate(one)]
    assert [abs(r.x_ac) * 1000 for r in one] == pytest.approx(list(spark.range(1).select(*far).first()), rel=0.01)


def test_universal_kriging_of_flat_neighbours(spark):
    """Neighbours at one place, at two places and on a plane leave drift terms open: least squares."""
    sets = {"place": [(3.1, 4.7, 2.3)] * 6, "places": [(3.1, 4.7, 2.3)] * 3 + [(3.3, 4.6, 2.2)] * 3, "plane": [(x / 3, y / 7, 2.0) for x in range(3) for y in range(2)]}
    for at in sets.values():
        o = np.array(at)
        v, q = np.arange(6) * 10.0 + 5, np.array([3.0, 4.5, 2.0])
        n = spark.createDataFrame([(1, float(np.linalg.norm(p - q)), *map(float, p), float(x)) for p, x in zip(o, v, strict=True)], "qid int, distance double, x double, y double, z double, value double")
        d = np.linalg.norm(o[:, None] - o, axis=2)
        f = np.c_[np.ones(6), o]
        a = np.block([[np.exp(-d) + 0.05 * np.eye(6), f], [f.T, np.zeros((4, 4))]])
        w = np.linalg.lstsq(a, np.r_[np.exp(-np.linalg.norm(o - q, axis=1)), 1, q], rcond=1e-12)[0][:6]
        got = scattered.kriging(n, spark.createDataFrame([(1, *map(float, q))], "qid int, x double, y double, z double"), ["x", "y", "z"], "matern_12", 1.0, 1.0, 0.05, drift="linear").first()
        assert (got.value, got.neighbours) == (pytest.approx(w @ v, rel=1e-8), 6)
