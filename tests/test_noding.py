"""Overlay, relations, buffers and dissolving by noding, against membership of points and plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as g
from tessera.operators import noding, planar
from tessera.session import ship

GEOM = g.GEOMETRY_T.simpleString()


def row(shape):
    return None if shape is None else (shape[0], [[[{"x": float(x), "y": float(y)} for x, y in r] for r in m] for m in shape[1]])


def shape_of(r):
    return r.kind, [[[(p.x, p.y) for p in ring] for ring in m] for m in r.parts]


def area(s):
    return sum(abs(planar._ring_area(r)) * (1 if i == 0 else -1) for m in s[1] for i, r in enumerate(m))


def inside(p, s):
    return sum(planar._ring_side(p, r) > 0 for m in s[1] for r in m) % 2 == 1


def ring(*ps):
    return [(float(x), float(y)) for x, y in (*ps, ps[0])]


def star(rng, cx, cy, n):
    return "polygon", [[ring(*[(cx + (r := rng.uniform(1, 5)) * math.cos(t), cy + r * math.sin(t)) for t in (2 * math.pi * (k + rng.random() * 0.9) / n for k in range(n))])]]


def corner(rng):
    x, y, w, h = rng.randint(0, 6), rng.randint(0, 6), rng.randint(2, 5), rng.randint(2, 5)
    return "polygon", [[ring((x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h))]]


def holed(rng):
    x, y = rng.randint(0, 3), rng.randint(0, 3)
    return "polygon", [[ring((x, y), (x + 8, y), (x + 8, y + 8), (x, y + 8)), ring((x + 1, y + 1), (x + 1, y + 3), (x + 3, y + 3), (x + 3, y + 1)), ring((x + 3, y + 3), (x + 3, y + 5), (x + 5, y + 5), (x + 5, y + 3))]]


def line(rng):
    p = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(2, 4))]
    p = [(float(x), float(y)) for i, (x, y) in enumerate(p) if i == 0 or p[i] != p[i - 1]]
    return "linestring", [[p if len(p) > 1 else [*p, (p[0][0] + 1, p[0][1])]]]


def dots(rng):
    return "multipoint", [[sorted({(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(3)})]]


@pytest.fixture(scope="module")
def areal(spark):
    ship(spark)
    rng = random.Random(5)
    pairs = [(star(rng, 5, 5, 11), star(rng, 6, 5, 9)) for _ in range(6)] + [(f(rng), h(rng)) for f, h in ((corner, corner), (holed, holed), (holed, corner)) for _ in range(6)]
    pairs.append((pairs[-1][0], pairs[-1][0]))
    pairs.append((("box", [[ring((0, 0), (2, 0), (2, 2), (0, 2))]]), ("box", [[ring((2, 2), (4, 2), (4, 4), (2, 4))]])))  # a common corner
    pairs.append((("polygon", []), pairs[0][0]))
    d = spark.createDataFrame([(k, "x", row(a), row(b)) for k, (a, b) in enumerate(pairs)], f"k long, other string, a {GEOM}, b {GEOM}")
    return pairs, noding.Pairs(d, ["k"], "a", "b")


@pytest.mark.parametrize("how", ["intersection", "union", "difference", "symmetric_difference"])
def test_overlays_hold_the_right_points(areal, how):
    pairs, both = areal
    rng = random.Random(6)
    got = {r.k: shape_of(r.geometry) for r in both.overlay(how).collect()}
    sizes = {r.k: r.area for r in both.area(how).collect()}
    want = {"intersection": lambda p, q: p and q, "union": lambda p, q: p or q, "difference": lambda p, q: p and not q, "symmetric_difference": lambda p, q: p != q}[how]
    for k, (a, b) in enumerate(pairs):
        s = got[k]
        assert s[0] == "multipolygon" and abs(area(s) - sizes[k]) < 1e-6 and not (planar.invalid(s) if s[1] else "")
        for _ in range(60):
            p = (rng.uniform(-1, 12) + 1e-4, rng.uniform(-1, 12) + 1e-4)
            assert inside(p, s) == want(inside(p, a), inside(p, b)), (k, p)


def test_relations_of_all_kinds(spark, areal):
    rng = random.Random(7)
    kinds = [corner, holed, line, dots]
    pairs = [(rng.choice(kinds)(rng), rng.choice(kinds)(rng)) for _ in range(60)]
    pairs.append((("multilinestring", [[[(0.0, 0.0), (2.0, 0.0)]], [[(2.0, 0.0), (4.0, 0.0)]]]), ("point", [[[(2.0, 0.0)]]])))  # two ends are no boundary
    d = spark.createDataFrame([(k, row(a), row(b)) for k, (a, b) in enumerate(pairs)], f"k long, a {GEOM}, b {GEOM}")
    r = noding.relations(d, ["k"], "a", "b")
    names = ["intersects", *[n for n in planar.PREDICATES if n != "intersects"]]
    got = {x.k: x for x in r.select("k", "relation", *[noding.predicate(n, F.col("relation"), F.col("dim_a"), F.col("dim_b")).alias(n) for n in names]).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k].relation == planar.relation(a, b), (a, b)
        assert [got[k][n] for n in names] == [bool(planar.PREDICATES[n](a, b)) for n in names], (a, b)


def test_lines_cut_by_shapes(spark):
    cases = [
        (("linestring", [[[(-1.0, 1.0), (5.0, 1.0), (5.0, 5.0)]]]), ("box", [[ring((0, 0), (4, 0), (4, 4), (0, 4))]])),
        (("linestring", [[[(0.0, 0.0), (4.0, 0.0)]]]), ("linestring", [[[(1.0, 0.0), (2.0, 0.0), (2.0, 3.0)]]])),
        (("multipoint", [[[(0.0, 0.0)]]]), ("box", [[ring((0, 0), (4, 0), (4, 4), (0, 4))]])),
    ]
    d = spark.createDataFrame([(k, row(a), row(b)) for k, (a, b) in enumerate(cases)], f"k long, a {GEOM}, b {GEOM}")
    both = noding.Pairs(d, ["k"], "a", "b")
    cut, left = ({r.k: r.geometry and shape_of(r.geometry) for r in both.overlay(h).collect()} for h in ("intersection", "difference"))
    assert cut[0] == ("multilinestring", [[[(0.0, 1.0), (4.0, 1.0)]]]) and left[0] == ("multilinestring", [[[(-1.0, 1.0), (0.0, 1.0)]], [[(4.0, 1.0), (5.0, 1.0), (5.0, 5.0)]]])
    assert cut[1] == ("multilinestring", [[[(1.0, 0.0), (2.0, 0.0)]]]) and len(left[1][1]) == 2
    assert cut[2] is None


def test_missing_and_odd_shapes(spark):
    box = ("box", [[ring((0, 0), (2, 0), (2, 2), (0, 2))]])
    wild = ("polygon", [[ring((0, 0), (float("inf"), 0), (2, 2))]])
    rows = [(1, None, row(box)), (2, row(box), row(wild)), (3, row(("polygon", [])), row(box)), (None, row(box), row(box)), (4, row(("polygon", [[[]]])), row(("linestring", [])))]
    d = spark.createDataFrame(rows, f"k long, a {GEOM}, b {GEOM}").withColumn("part", F.lit(1))
    both = noding.Pairs(d, ["k"], "a", "b")
    rel = {r.k: r.relation for r in both.relations().collect()}
    assert rel[1] is None and rel[2] is None and rel[None] == "2FFF1FFF2"
    got = {r.k: r.geometry for r in both.overlay("union").collect()}
    assert got[1] is None and got[2] is None and area(shape_of(got[3])) == 4 and area(shape_of(got[None])) == 4
    assert both.overlay().where("k = 3").first().geometry.parts == []
    assert noding.relations(d.limit(0), ["k"], "a", "b").count() == 0 and noding.overlay(d.limit(0), ["k"], "a", "b").count() == 0
    with pytest.raises(ValueError):
        both.overlay("sum")


def test_dissolve_and_buffers(spark):
    rng = random.Random(8)
    boxes = [(k % 2, x := rng.randint(0, 20), y := rng.randint(0, 20), x + rng.randint(1, 6), y + rng.randint(1, 6)) for k in range(60)]
    d = spark.createDataFrame([(k, row(("box", [[ring((a, b), (c, b), (c, e), (a, e))]]))) for k, a, b, c, e in boxes], f"k long, s {GEOM}")
    got = {r.k: shape_of(r.geometry) for r in noding.dissolve(d, ["k"], "s").collect()}
    for k in (0, 1):
        cells = {(i, j) for n, a, b, c, e in boxes if n == k for i in range(a, c) for j in range(b, e)}
        assert area(got[k]) == len(cells) and all(inside((i + 0.5, j + 0.5), got[k]) == ((i, j) in cells) for i in range(27) for j in range(27))
    shapes = {1: ("polygon", [[ring((0, 0), (8, 0), (8, 3), (3, 3), (3, 6), (0, 6)), ring((1, 1), (1, 2), (2, 2), (2, 1))]]), 2: ("linestring", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (8.0, 4.0)]]]), 3: ("multipoint", [[[(0.0, 0.0), (1.0, 0.0)]]])}
    t = spark.createDataFrame([(k, row(s)) for k, s in shapes.items()] + [(9, None)], f"k long, s {GEOM}")
    for options in ({"point": "square"}, {"join": "miter", "end": "flat", "right": 0.5}):
        got = {r.k: r.geometry for r in noding.buffer(t, ["k"], "s", 1.0, **options).collect()}
        assert got[9] is None
        for k, s in shapes.items():
            want = planar.buffer(s, 1.0, **{"n": 36} | options)
            assert abs(area(shape_of(got[k])) - area(want)) < 1e-5, (options, k)
    got = {r.k: r.geometry for r in noding.buffer(t, ["k"], "s", -0.25).collect()}
    assert all(abs(area(shape_of(got[k])) - area(planar.buffer(shapes[k], -0.25))) < 1e-5 for k in shapes)


def test_simple_lines(spark):
    lines = {1: [(0, 0), (2, 2), (2, 0), (0, 2)], 2: [(0, 0), (2, 0), (2, 2), (0, 0)], 3: [(0, 0), (3, 0), (1, 0)], 4: [(0, 0), (2, 0), (2, 2), (1, 0)], 5: [(0, 0), (5, 1)]}
    d = spark.createDataFrame([(k, row(("linestring", [[[(float(x), float(y)) for x, y in p]]]))) for k, p in lines.items()] + [(6, row(("multipoint", [[[(1.0, 1.0), (1.0, 1.0)]]]))), (7, None)], f"k long, s {GEOM}")
    got = {r.k: r.simple for r in noding.simple(d, ["k"], "s").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: None}


@pytest.mark.parametrize("block", [noding.BLOCK, 10])
def test_many_pieces_in_one_pair(spark, block):
    """Two combs of 9 teeth that cross: 81 squares, and one shape around 64 holes."""
    n = 9
    bar = lambda i, turn: ring((2 * i, 0), (2 * i + 1, 0), (2 * i + 1, 2 * n), (2 * i, 2 * n)) if not turn else ring((0, 2 * i), (2 * n, 2 * i), (2 * n, 2 * i + 1), (0, 2 * i + 1))
    a, b = (("multipolygon", [[bar(i, turn)] for i in range(n)]) for turn in (False, True))
    both = noding.Pairs(spark.createDataFrame([(1, row(a), row(b))], f"k long, a {GEOM}, b {GEOM}"), ["k"], "a", "b", block=block)
    r = both.overlays("intersection", "union").first()
    cut, all_ = shape_of(r.intersection), shape_of(r.union)
    assert len(cut[1]) == n * n and area(cut) == n * n
    assert len(all_[1]) == 1 and len(all_[1][0]) == 1 + (n - 1) ** 2 and area(all_) == 2 * n * 2 * n - n * n


def test_distance_and_hull_without_python(spark):
    rng = random.Random(9)
    kinds = [corner, holed, line, dots, lambda r: star(r, 15, 3, 7)]
    pairs = [(rng.choice(kinds)(rng), rng.choice(kinds)(rng)) for _ in range(50)]
    d = spark.createDataFrame([(k, row(a), row(b)) for k, (a, b) in enumerate(pairs)], f"k long, a {GEOM}, b {GEOM}")
    out = d.select("k", g.distance(F.col("a"), F.col("b")).alias("d"), g.closest_points(F.col("a"), F.col("b")).alias("c"), g.convex_hull(F.col("a")).alias("h"))
    for r in out.collect():
        a, b = pairs[r.k]
        assert abs(r.d - planar.distance(a, b)) < 1e-9
        p, q = shape_of(r.c)[1][0][0]
        assert abs(math.hypot(p[0] - q[0], p[1] - q[1]) - r.d) < 1e-9 and abs(planar.distance(("point", [[[p]]]), a)) < 1e-9
        assert abs(area(shape_of(r.h)) - area(planar.hull(a))) < 1e-9
    few = spark.createDataFrame([(row(("point", [[[(1.0, 2.0)]]])),), (row(("polygon", [])),), (None,)], f"s {GEOM}")
    assert [h.h and h.h.parts for h in few.select(g.convex_hull(F.col("s")).alias("h")).collect()][1:] == [[], None]


def test_holes_of_any_form(spark):
    """Bent holes that overhang themselves, one around an island with a hole of its own."""
    frame = lambda x, y, w, t=1: [ring((x, y), (x + w, y), (x + w, y + w), (x, y + w)), ring((x + t, y + t), (x + w - t, y + t), (x + w - t, y + w - t), (x + t, y + w - t))]
    hook = ring((2, 2), (18, 2), (18, 18), (2, 18), (2, 12), (4, 12), (4, 16), (16, 16), (16, 4), (2, 4))
    a = ("multipolygon", [[ring((0, 0), (20, 0), (20, 20), (0, 20))]])
    b = ("polygon", [[hook]])
    c = ("multipolygon", [frame(30, 0, 20), frame(33, 3, 14), frame(36, 6, 8)])
    none = ("polygon", [])
    d = spark.createDataFrame([(1, row(a), row(b)), (2, row(c), row(none))], f"k long, a {GEOM}, b {GEOM}")
    got = {r.k: shape_of(r.geometry) for r in noding.Pairs(d, ["k"], "a", "b").overlay("difference").collect()}
    assert area(got[1]) == 400 - abs(planar._ring_area(hook)) and [len(m) for m in got[1][1]] == [2] and planar.invalid(got[1]) == ""
    assert area(got[2]) == area(c) and sorted(len(m) for m in got[2][1]) == [2, 2, 2] and planar.invalid(got[2]) == ""


def test_joins_of_pieces_are_not_broadcast(spark):
    """What grows with the shapes never goes through the driver."""
    d = spark.range(3).select("id", g.box(F.lit(0.0), F.lit(0.0), F.col("id") + 2.0, F.lit(2.0)).alias("a"), g.box(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(5.0)).alias("b"))
    p = noding.Pairs(d, ["id"], "a", "b")
    for made in (p.noded.sided(), p.overlay("union"), p.area(), p.relations(), noding.dissolve(d, ["id"], "a")):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_spatial_join_of_all_sizes(spark, monkeypatch):
    """Boxes of sizes from none to 2000 and copies of them, against brute force; equal pairs are related once."""
    rng = random.Random(5)
    made = [(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.01, 0.7, 4.0, 8.0, 60.0, 2000.0])) for _ in range(40)]
    rows = lambda n, shift: [(i, x + shift, y, s) for i in range(n) for x, y, s in [made[i % 40]]]
    boxed = lambda r: spark.createDataFrame(r, "i int, x double, y double, s double").select("i", F.when(F.col("s") == 0, g.point(F.col("x"), F.col("y"))).otherwise(g.box(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s"))).alias("g"))
    a, b = rows(120, 0.0), rows(80, 0.5)
    related, real = [], noding.relations
    monkeypatch.setattr(noding, "relations", lambda pairs, *r: related.append(pairs.count()) or real(pairs, *r))
    got = sorted((r[0], r[1]) for r in g.spatial_join(boxed(a).toDF("i", "p"), boxed(b).toDF("j", "q"), "p", "q").select("i", "j").collect())
    want = sorted((i, j) for i, x, y, s in a for j, u, v, t in b if x <= u + t and u <= x + s and y <= v + t and v <= y + s)
    assert got == want and related[0] * 6 == len(want)


def test_equal_shapes_and_edges_are_dissolved_once(spark, monkeypatch):
    """50 copies of a row of four unit squares and of a box over it, in either order of points, as of one each."""
    unit = lambda i: ring((i, 0), (i + 1, 0), (i + 1, 1), (i, 1))
    shapes = [("polygon", [[unit(i)[::s]]]) for i in range(4) for s in (1, -1)] + [("polygon", [[ring((1, 0), (3, 0), (3, 2), (1, 2))]])]
    d = spark.createDataFrame([(n % 2, row(s)) for n in range(100) for s in shapes], f"k long, s {GEOM}")
    noded, real = [], noding._cuts
    monkeypatch.setattr(noding, "_cuts", lambda edges: noded.append(edges.count()) or real(edges))
    got = {r.k: shape_of(r.geometry) for r in noding.dissolve(d, ["k"], "s").collect()}
    assert [area(got[k]) for k in (0, 1)] == [6, 6] and all(len(s[1]) == 1 and len(s[1][0]) == 1 and not planar.invalid(s) for s in got.values())
    assert noded[0] == 2 * (8 + 2 + 4)  # no border between squares


@pytest.mark.parametrize("collide", [False, True])
def test_equal_pairs_are_noded_once(spark, monkeypatch, collide):
    """40 rows each of five pairs, one of them with a missing shape, also where all digests are equal."""
    box = lambda x, y, w: ("box", [[ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))]])
    pairs = [(box(0, 0, 4), box(2, 2, 4)), (box(2, 2, 4), box(0, 0, 3)), (box(0, 0, 4), box(1, 1, 1)), (None, box(0, 0, 4)), (box(0, 0, 4), None)]
    d = spark.createDataFrame([(n, str(n), row(a), row(b)) for n in range(200) for a, b in [pairs[n % 5]]], f"id long, name string, a {GEOM}, b {GEOM}")
    if collide:
        monkeypatch.setattr(noding, "_digest", lambda *shapes: F.lit(1).cast("long"))
    p = noding.Pairs(d, ["id", "name"], "a", "b")
    assert p.rows.count() == 5 and p.noded.edges.count() == 3 * 8
    cut, sizes, found = ({r.id: r for r in x.collect()} for x in (p.overlay(), p.area("union"), p.relations()))
    assert len(cut) == len(sizes) == len(found) == 200
    for n in range(200):
        a, b = pairs[n % 5]
        assert cut[n].name == str(n)
        if a is None or b is None:
            assert cut[n].geometry is None and sizes[n].area is None and found[n].relation is None
        else:
            assert area(shape_of(cut[n].geometry)) == (4, 1, 1)[n % 5] and sizes[n].area == (28, 24, 16)[n % 5] and found[n].relation == planar.relation(a, b)


def test_nodes_are_written_once(spark):
    """Edges that meet in several tiles have each node once."""
    a, b = ("polygon", [[ring((0, 0), (9, 1), (1, 9))]]), ("polygon", [[ring((0, 0), (9, 1), (9, 9))]])
    p = noding.Pairs(spark.createDataFrame([(1, row(a), row(b))], f"k long, a {GEOM}, b {GEOM}"), ["k"], "a", "b")
    assert p.noded.nodes.count() == p.noded.nodes.select("side", "i", "x", "y").distinct().count() == 6 * 2 + 2
    assert p.relations().first().relation == planar.relation(a, b)
