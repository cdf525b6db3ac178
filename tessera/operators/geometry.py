"""Geometries as columns: measures, editing and text forms by expressions.

A geometry is ``struct<kind, parts>``; ``parts`` is an array of members, each an array of rings or
lines, each an array of points (x, y), for every kind:

point, multipoint, segment, linestring: one member with one list of points; ring: one closed list;
box: one closed list around the box; polygon: one member, outer ring first, then holes;
multilinestring, multipolygon: a member for each.

Degrees of longitude and latitude are x and y in the geodetic forms. Predicates and overlays that
need two whole geometries are in ``planar``, run on flat arrays that Arrow hands over.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geodesic
from tessera.functions.geodesy import WGS84, Spheroid, haversine
from tessera.functions.let import let
from tessera.session import saved

from . import planar

POINT_T = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS_T = T.ArrayType(T.ArrayType(T.ArrayType(POINT_T)))
GEOMETRY_T = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", PARTS_T)])
KINDS = ("point", "segment", "box", "linestring", "ring", "polygon", "multipoint", "multilinestring", "multipolygon")
AREAL = ("box", "ring", "polygon", "multipolygon")


def pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.cast(PARTS_T).alias("parts"))


def point(x: Column, y: Column) -> Column:
    return make("point", F.array(F.array(F.array(pt(x, y)))))


def line(points: Column, kind: str = "linestring") -> Column:
    return make(kind, F.array(F.array(points)))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return make("box", F.array(F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)))))


def polygon(outer: Column, holes: Column | None = None) -> Column:
    rings = F.array(outer) if holes is None else F.concat(F.array(outer), holes)
    return make("polygon", F.array(rings))


# shape
def lists(g: Column) -> Column:
    return F.flatten(g["parts"])


def points(g: Column) -> Column:
    return F.flatten(lists(g))


def is_areal(g: Column) -> Column:
    return g["kind"].isin(*AREAL)


def num_points(g: Column) -> Column:
    return F.size(points(g))


def num_segments(g: Column) -> Column:
    n = F.aggregate(lists(g), F.lit(0), lambda a, r: a + F.greatest(F.size(r) - 1, F.lit(0)))
    return F.when(g["kind"].isin("point", "multipoint"), F.lit(0)).otherwise(n)


def num_geometries(g: Column) -> Column:
    return F.when(g["kind"] == "multipoint", num_points(g)).when(g["kind"].startswith("multi"), F.size(g["parts"])).otherwise(F.when(is_empty(g), F.lit(0)).otherwise(F.lit(1)))


def num_interior_rings(g: Column) -> Column:
    return F.when(g["kind"].isin("polygon", "multipolygon"), F.aggregate(g["parts"], F.lit(0), lambda a, p: a + F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(F.lit(0))


def is_empty(g: Column) -> Column:
    return F.size(points(g)) == 0


def clear(g: Column) -> Column:
    return F.struct(g["kind"].alias("kind"), F.array().cast(PARTS_T).alias("parts"))


def _each_list(g: Column, f) -> Column:
    return F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda p: F.transform(p, f)).alias("parts"))


def reverse(g: Column) -> Column:
    return _each_list(g, F.reverse)


def unique(g: Column) -> Column:
    """Without points equal to the one before."""
    return _each_list(g, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))


def envelope(g: Column) -> Column:
    xs, ys = F.transform(points(g), lambda p: p["x"]), F.transform(points(g), lambda p: p["y"])
    return F.when(~is_empty(g), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def bounds(g: Column) -> Column:
    """xmin, ymin, xmax, ymax, for equality and range prefilters of joins."""
    xs, ys = F.transform(points(g), lambda p: p["x"]), F.transform(points(g), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


# measures
def _fold(r: Column, f) -> Column:
    """Sum of f(point, next point) along a list."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + F.coalesce(f(F.get(r, i - 1), F.get(r, i)), F.lit(0.0)))


def ring_area(r: Column) -> Column:
    """Signed, positive if counter-clockwise."""
    return _fold(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def _signed(g: Column, ring) -> Column:
    """Outer rings less holes."""
    one = lambda p: F.aggregate(F.transform(p, lambda r, i: F.abs(ring(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(is_areal(g), F.aggregate(F.transform(g["parts"], one), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def area(g: Column) -> Column:
    return _signed(g, ring_area)


def geodetic_area(g: Column, spheroid: Spheroid = WGS84, strategy: str = "authalic") -> Column:
    """Square metres: the polygon on the sphere of equal area, at authalic latitudes; exact for
    edges along meridians and parallels, close for short ones. By ``karney`` edges are geodesics."""
    if strategy == "karney":
        signs = F.flatten(F.transform(g["parts"], lambda p: F.transform(p, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0))))
        sides = F.zip_with(geodesic_measures(g, spheroid)["areas"], signs, lambda a, s: F.abs(a) * s)
        return F.when(is_areal(g), F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)).otherwise(F.when(g.isNotNull(), 0.0))
    e, r = math.sqrt(spheroid.e2), spheroid.authalic_radius
    full = 1 + (1 - e * e) / (2 * e) * math.log((1 + e) / (1 - e))

    def sin_b(p: Column) -> Column:
        s = F.sin(F.radians(p["y"]))
        return (1 - e * e) * (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)) / F.lit(full)

    def wrap(d: Column) -> Column:
        return F.pmod(d + 180.0, F.lit(360.0)) - 180.0

    return _signed(g, lambda ring: _fold(ring, lambda p, q: F.radians(wrap(q["x"] - p["x"])) * (sin_b(p) + sin_b(q)) / 2) * F.lit(r * r))


def _planar(p: Column, q: Column) -> Column:
    return F.hypot(q["x"] - p["x"], q["y"] - p["y"])


def _metres(strategy: str, spheroid: Spheroid):
    if strategy == "haversine":
        return lambda p, q: haversine(p["x"], p["y"], q["x"], q["y"], spheroid.mean_radius)
    if strategy == "andoyer":
        return lambda p, q: spheroid.andoyer(p["x"], p["y"], q["x"], q["y"])
    raise ValueError(f"no strategy {strategy!r} inside expressions")


def _along(g: Column, dist) -> Column:
    return F.aggregate(F.transform(lists(g), lambda r: _fold(r, dist)), F.lit(0.0), lambda a, x: a + x)


def geodesic_measures(g: Column, spheroid: Spheroid = WGS84) -> Column:
    """struct(length, areas) of all lists, edges being geodesics."""
    return geodesic.measures(points(g), F.transform(lists(g), F.size), spheroid)


def length(g: Column, strategy: str | None = None, spheroid: Spheroid = WGS84) -> Column:
    """Of lines; planar, or in metres by a strategy (haversine, andoyer, karney)."""
    if strategy == "karney":
        return F.when(g["kind"].isin("segment", "linestring", "multilinestring"), geodesic_measures(g, spheroid)["length"]).otherwise(F.when(g.isNotNull(), 0.0))
    d = _planar if strategy is None else _metres(strategy, spheroid)
    return F.when(g["kind"].isin("segment", "linestring", "multilinestring"), _along(g, d)).otherwise(F.lit(0.0))


def perimeter(g: Column, strategy: str | None = None, spheroid: Spheroid = WGS84) -> Column:
    if strategy == "karney":
        return F.when(is_areal(g), geodesic_measures(g, spheroid)["length"]).otherwise(F.when(g.isNotNull(), 0.0))
    d = _planar if strategy is None else _metres(strategy, spheroid)
    return F.when(is_areal(g), _along(g, d)).otherwise(F.lit(0.0))


def centroid(g: Column) -> Column:
    """Of areas by area, of lines by length, of points their mean."""
    def total(f) -> Column:
        return F.aggregate(F.transform(g["parts"], lambda p: F.aggregate(F.transform(p, lambda r, i: _fold(r, f) * F.when(i == 0, F.signum(ring_area(r))).otherwise(-F.signum(ring_area(r)))), F.lit(0.0), lambda a, x: a + x)), F.lit(0.0), lambda a, x: a + x)

    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    a = total(cross) * 3
    poly = pt(total(lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / a, total(lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / a)
    n = _along(g, _planar)
    lin = pt(_along(g, lambda p, q: _planar(p, q) * (p["x"] + q["x"]) / 2) / n, _along(g, lambda p, q: _planar(p, q) * (p["y"] + q["y"]) / 2) / n)
    k = F.size(points(g))
    mean = lambda c: F.aggregate(points(g), F.lit(0.0), lambda s, p: s + p[c]) / k
    return F.when(is_empty(g), None).when(is_areal(g), poly).when(g["kind"].isin("point", "multipoint"), pt(mean("x"), mean("y"))).otherwise(lin)


def azimuth(p: Column, q: Column) -> Column:
    """Planar, radians clockwise from the y axis, 0 to 2 pi."""
    return F.pmod(F.atan2(q["x"] - p["x"], q["y"] - p["y"]), F.lit(2 * math.pi))


def curvilinear_distance(points_: Column, strategy: str = "haversine", spheroid: Spheroid = WGS84) -> Column:
    """Metres along a list of points up to each, the first 0."""
    d = _metres(strategy, spheroid)
    steps = F.transform(points_, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(d(F.get(points_, i - 1), p)))
    return F.aggregate(steps, F.array().cast("array<double>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + s)))


def pairwise_distance(a: Column, b: Column, strategy: str | None = None, spheroid: Spheroid = WGS84) -> Column:
    return F.zip_with(a, b, _planar if strategy is None else _metres(strategy, spheroid))


# editing
def correct(g: Column) -> Column:
    """Rings closed, outer ones counter-clockwise and holes clockwise."""
    def close(r: Column) -> Column:
        return F.when(F.size(r) < 1, r).when(F.get(r, F.lit(0)) != F.element_at(r, -1), F.concat(r, F.slice(r, 1, 1))).otherwise(r)

    fixed = F.transform(g["parts"], lambda p: F.transform(p, lambda r, i: F.when((ring_area(close(r)) < 0) == (i == 0), F.reverse(close(r))).otherwise(close(r))))
    return F.struct(g["kind"].alias("kind"), F.when(is_areal(g), fixed).otherwise(g["parts"]).alias("parts"))


def densify(g: Column, most: float, strategy: str | None = None, spheroid: Spheroid = WGS84) -> Column:
    """With points put in so that no segment is longer than ``most``."""
    d = _planar if strategy is None else _metres(strategy, spheroid)

    def along(r: Column) -> Column:
        def cut(p: Column, i: Column) -> Column:
            q = F.get(r, i + 1)
            n = F.coalesce(F.greatest(F.ceil(d(p, q) / most), F.lit(1)), F.lit(1)).cast("int")
            return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, p).otherwise(pt(p["x"] + (q["x"] - p["x"]) * k / n, p["y"] + (q["y"] - p["y"]) * k / n)))

        return F.flatten(F.transform(r, cut))

    return _each_list(g, along)


def line_interpolate(points_: Column, at: Column) -> Column:
    """The point ``at`` planar units along; beyond the end the last point."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points_) - 1, F.lit(1))), lambda i: F.struct(F.get(points_, i - 1).alias("p"), F.get(points_, i).alias("q"), _planar(F.get(points_, i - 1), F.get(points_, i)).alias("d")))
    start = F.struct(at.cast("double").alias("left"), F.lit(None).cast(POINT_T).alias("hit"))

    def step(a: Column, s: Column) -> Column:
        t = a["left"] / s["d"]
        here = a["hit"].isNull() & (a["left"] <= s["d"]) & (s["d"] > 0)
        return F.struct((a["left"] - s["d"]).alias("left"), F.when(a["hit"].isNotNull(), a["hit"]).when(here, pt(s["p"]["x"] + (s["q"]["x"] - s["p"]["x"]) * t, s["p"]["y"] + (s["q"]["y"] - s["p"]["y"]) * t)).alias("hit"))

    return F.coalesce(F.when(at <= 0, F.get(points_, F.lit(0))), F.aggregate(steps, start, step, lambda a: a["hit"]), F.element_at(points_, -1))


# conversions
def transform_to(g: Column, kind: str) -> Column:
    """To another kind: points of any kind to multipoint, lists to lines, areas to rings and polygons, ..."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}")
    if kind in ("multipoint", "point", "segment", "linestring"):
        parts = F.array(F.array(points(g)))
    elif kind == "ring":
        parts = F.array(F.array(F.get(lists(g), F.lit(0))))
    elif kind == "box":
        return envelope(g)
    elif kind == "multilinestring":
        parts = F.transform(lists(g), lambda r: F.array(r))
    else:
        parts = g["parts"]
    return make(kind, parts)


def geographic(g: Column) -> Column:
    """x, y become lon, lat."""
    return F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q["x"].alias("lon"), q["y"].alias("lat"))))).alias("parts"))


def cartesian(g: Column) -> Column:
    return F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y"))))).alias("parts"))


# text
def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _coords(r: Column, left: str, sep: str, right: str) -> Column:
    return F.array_join(F.transform(r, lambda p: F.concat(F.lit(left), _number(p["x"]), F.lit(sep), _number(p["y"]), F.lit(right))), ",")


def to_wkt(g: Column) -> Column:
    one = lambda r: F.concat(F.lit("("), _coords(r, "", " ", ""), F.lit(")"))
    rings = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, one), ","), F.lit(")"))
    members = F.concat(F.lit("("), F.array_join(F.transform(g["parts"], rings), ","), F.lit(")"))
    flat = one(points(g))
    name = F.when(g["kind"] == "segment", F.lit("LINESTRING")).when(g["kind"].isin("box", "ring"), F.lit("POLYGON")).otherwise(F.upper(g["kind"]))
    multi_lines = F.concat(F.lit("("), F.array_join(F.transform(lists(g), one), ","), F.lit(")"))
    body = F.when(is_empty(g), F.lit(" EMPTY")).when(g["kind"].isin("point", "segment", "linestring", "multipoint"), flat).when(g["kind"] == "multilinestring", multi_lines).when(g["kind"] == "multipolygon", members).otherwise(rings(F.get(g["parts"], F.lit(0))))
    return F.concat(name, body)


def _parsed(kind: Column, text: Column) -> Column:
    """Nested brackets around {"x":..,"y":..} to parts, by how deep the kind nests."""
    wrap = F.when(kind.isin("point", "multipoint", "linestring"), F.concat(F.lit("[["), text, F.lit("]]"))).when(kind == "multilinestring", F.regexp_replace(F.concat(F.lit("["), text, F.lit("]")), r"\],\[", "]],[[")).when(kind == "polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.struct(kind.alias("kind"), F.from_json(wrap, PARTS_T).alias("parts"))


_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def from_wkt(text: Column) -> Column:
    kind = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)(\(.*\))", 1), r"\s*([(),])\s*", "$1")
    body = F.when(kind == "multipoint", F.regexp_replace(body, r"\(([^()]*)\)(?=[,)])", "$1")).otherwise(body)
    body = F.regexp_replace(body, _NUMBER + r"\s+" + _NUMBER, r'{"x":$1,"y":$2}')
    body = F.translate(body, "()", "[]")
    return F.when(text.rlike(r"(?i)\bEMPTY\s*$"), F.struct(kind.alias("kind"), F.array().cast(PARTS_T).alias("parts"))).otherwise(_parsed(kind, body))


_GEOJSON = {"point": "Point", "segment": "LineString", "linestring": "LineString", "ring": "LineString", "box": "Polygon", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon"}


def to_geojson(g: Column) -> Column:
    one = lambda r: F.concat(F.lit("["), _coords(r, "[", ",", "]"), F.lit("]"))
    rings = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, one), ","), F.lit("]"))
    kind = F.coalesce(*[F.when(g["kind"] == k, F.lit(v)) for k, v in _GEOJSON.items()])
    body = F.when(g["kind"] == "point", _coords(points(g), "[", ",", "]")).when(g["kind"].isin("segment", "linestring", "multipoint", "ring"), one(points(g))).when(g["kind"] == "multilinestring", F.concat(F.lit("["), F.array_join(F.transform(lists(g), one), ","), F.lit("]"))).when(g["kind"] == "multipolygon", F.concat(F.lit("["), F.array_join(F.transform(g["parts"], rings), ","), F.lit("]"))).otherwise(rings(F.get(g["parts"], F.lit(0))))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))


def from_geojson(text: Column) -> Column:
    kind = F.lower(F.get_json_object(text, "$.type"))
    body = F.regexp_replace(F.get_json_object(text, "$.coordinates"), r"\s", "")
    body = F.regexp_replace(body, r"\[" + _NUMBER + "," + _NUMBER + r"(?:,[^\]]*)?\]", r'{"x":$1,"y":$2}')
    body = F.when(kind == "point", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return _parsed(kind, body)


# whole geometries, in Python: they travel as JSON text, as lists of unequal lengths nest
def _packed(g: Column) -> list[Column]:
    """A geometry as flat arrays for Arrow: kind, coordinates in turn, points of each list, lists of
    each member; all NULL of a NULL."""
    xy = F.flatten(F.transform(points(g), lambda p: F.array(p["x"], p["y"])))
    return [g["kind"], xy, F.transform(lists(g), F.size), F.transform(g["parts"], F.size)]


def _unpacked(kind: str | None, xy, sizes, members) -> tuple[str, list] | None:
    if kind is None:
        return None
    flat = np.asarray(xy, float)
    pts, out, at, ring = list(zip(flat[::2].tolist(), flat[1::2].tolist(), strict=True)), [], 0, 0
    for n in members:
        own = []
        for m in sizes[ring : ring + n]:
            own.append(pts[at : at + m])
            at += m
        out.append(own)
        ring += n
    return kind, out


def _written(g: tuple[str, list] | None) -> str | None:
    return None if g is None else json.dumps({"kind": g[0], "parts": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in m] for m in g[1]]})


def _called(f, schema: str, *geometries: Column) -> Column:
    """f of the geometries of each row, NULL if one is NULL."""

    @F.pandas_udf(schema)
    def run(*cols: pd.Series) -> pd.Series:
        given = [[_unpacked(*row) for row in zip(*cols[k : k + 4], strict=True)] for k in range(0, len(cols), 4)]
        return pd.Series([None if any(g is None for g in row) else f(*row) for row in zip(*given, strict=True)], dtype=object)

    return run(*[c for g in geometries for c in _packed(g)])


def _shaped(f, *geometries: Column) -> Column:
    return F.from_json(_called(lambda *g: _written(f(*g)), "string", *geometries), GEOMETRY_T)


def relation(a: Column, b: Column) -> Column:
    """The nine characters of the DE-9IM matrix."""
    return _called(planar.relation, "string", a, b)


def relate(a: Column, b: Column, mask: str) -> Column:
    return _called(lambda g, h: planar.matches(planar.relation(g, h), mask), "boolean", a, b)


def predicate(name: str, a: Column, b: Column) -> Column:
    """intersects, disjoint, within, covered_by, touches, crosses, overlaps or equals. Boxes are
    compared first, inside the JVM: only pairs whose boxes meet go to the exact test."""
    p, q = bounds(a), bounds(b)
    near = (p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"])
    met = lambda g: F.when(near, g)
    exact = _called(planar.PREDICATES[name], "boolean", met(a), met(b))
    return F.when(a.isNull() | b.isNull(), None).when(~near, F.lit(name == "disjoint")).otherwise(exact)


def intersects(a: Column, b: Column) -> Column:
    return predicate("intersects", a, b)


def spatial_join(a: DataFrame, b: DataFrame, left: str, right: str, name: str = "intersects", tile: float | None = None) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose geometries ``left`` and ``right`` fulfil a predicate (any
    but disjoint), with the columns of both. Equal geometries of a side are related once. Each geometry
    has a level, the least power of two that its box does not exceed, and two meet in the tiles of the
    higher of their levels, so none is dealt to more than four tiles of a level; with ``tile`` all meet
    in tiles of that width. A pair is taken in the first tile that it shares. Empty and NULL geometries,
    and those with a coordinate that is not finite, join with nothing."""
    if name not in planar.PREDICATES or name == "disjoint":
        raise ValueError(f"no join by {name!r}")
    from . import noding  # which works on these columns

    def distinct(df: DataFrame, g: str) -> DataFrame:
        d = df.select(F.col(g).alias("g")).distinct().withColumn("b", bounds(F.col("g")))
        d = d.where(F.forall(F.array(*[F.col(f"b.{c}") for c in ("xmin", "xmax", "ymin", "ymax")]), lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False))))
        return saved(d.withColumn("size", F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin"))).withColumn("id", F.monotonically_increasing_id()))

    p, q = distinct(a, left), distinct(b, right)
    far = p.select("b").union(q.select("b")).agg(F.max(F.greatest(*[F.abs(F.col(f"b.{c}")) for c in ("xmin", "xmax", "ymin", "ymax")]))).first()[0]
    least = math.floor(math.log2(far or 1.0)) - 40  # indices of tiles stay below 2 ** 41
    level = F.lit(0) if tile is not None else F.greatest(F.ceil(F.log2(F.when(F.col("size") > 0, F.col("size")))).cast("int"), F.lit(least))
    p, q = p.withColumn("level", level), q.withColumn("level", level)
    levels = lambda df: [r[0] for r in df.select("level").distinct().collect()]
    every = {"p": levels(p), "q": levels(q)}

    def dealt(df: DataFrame, s: str) -> DataFrame:
        """In its own level, and in those of the other side that are higher; of equal levels p is the higher."""
        own, other = (0, 1) if s == "p" else (1, 0)
        higher = F.filter(F.array(*[F.lit(x) for x in every["q" if s == "p" else "p"]]).cast("array<int>"), lambda x: (x > F.col("level")) if s == "p" else (x >= F.col("level")))
        ways = F.concat(F.array(F.struct(F.lit(own).alias("side"), F.col("level").alias("at"))), F.transform(higher, lambda x: F.struct(F.lit(other).alias("side"), x.alias("at"))))
        d = df.select(F.col("id").alias(f"{s}id"), F.col("b").alias(f"{s}b"), F.explode(ways).alias("way")).select("*", "way.*")
        d = d.withColumn("width", F.lit(float(tile)) if tile is not None else F.pow(F.lit(2.0), F.col("at")))
        span = lambda c: F.sequence(F.floor(F.col(f"{s}b.{c}min") / F.col("width")).cast("long"), F.floor(F.col(f"{s}b.{c}max") / F.col("width")).cast("long"))
        d = d.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
        return d.drop("way", "width") if s == "q" else d.drop("way")

    first = lambda c: F.floor(F.greatest(F.col(f"pb.{c}min"), F.col(f"qb.{c}min")) / F.col("width"))
    meets = lambda c: (F.col(f"pb.{c}min") <= F.col(f"qb.{c}max")) & (F.col(f"qb.{c}min") <= F.col(f"pb.{c}max"))
    met = dealt(p, "p").hint("merge").join(dealt(q, "q"), ["side", "at", "tx", "ty"]).where((F.col("tx") == first("x")) & (F.col("ty") == first("y")) & meets("x") & meets("y"))
    met = saved(met.select("pid", "qid", F.monotonically_increasing_id().alias("pair")))
    shape = lambda df, s: df.select(F.col("id").alias(f"{s}id"), F.col("g").alias("a" if s == "p" else "b"))
    found = noding.relations(met.hint("merge").join(shape(p, "p"), "pid").join(shape(q, "q"), "qid").select("pair", "a", "b"), ["pair"], "a", "b")
    fits = found.where(noding.predicate(name, F.col("relation"), F.col("dim_a"), F.col("dim_b"))).select("pair")
    fits = met.hint("merge").join(fits, "pair", "left_semi").select("pid", "qid")
    rows = lambda df, g, d, s: df.select(F.struct("*").alias(s), F.col(g).alias("g")).hint("merge").join(d.select("g", F.col("id").alias(f"{s}id")), "g").select(s, f"{s}id")
    return rows(a, left, p, "p").hint("merge").join(fits, "pid").hint("merge").join(rows(b, right, q, "q"), "qid").select("p.*", "q.*")


def _sides(g: Column) -> Column:
    """Edges (p, q) of a shape; points as edges without length."""
    steps = lambda r: F.filter(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: i < F.size(r))
    along = F.flatten(F.transform(lists(g), lambda r: F.transform(steps(r), lambda i: F.struct(F.get(r, i - 1).alias("p"), F.get(r, i).alias("q")))))
    return F.when(g["kind"].isin("point", "multipoint"), F.transform(points(g), lambda p: F.struct(p.alias("p"), p.alias("q")))).otherwise(along)


_NEAR_T = "struct<d:double,p:struct<x:double,y:double>,q:struct<x:double,y:double>>"


def _nearest(a: Column, b: Column) -> Column:
    """The least distance of two shapes with the points it is between, by all edges of one and the
    other inside a row; a place inside of an area is at no distance. NULL without points."""
    def near(p: Column, e: Column, turned: bool) -> Column:
        x, y = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        size = x * x + y * y
        t = F.when(size == 0, 0.0).otherwise(F.least(F.greatest(((p["x"] - e["p"]["x"]) * x + (p["y"] - e["p"]["y"]) * y) / size, F.lit(0.0)), F.lit(1.0)))
        q = pt(e["p"]["x"] + t * x, e["p"]["y"] + t * y)
        d = F.hypot(p["x"] - q["x"], p["y"] - q["y"])
        return F.struct(d.alias("d"), (q if turned else p).alias("p"), (p if turned else q).alias("q"))

    def between(e: Column, f: Column) -> Column:
        rx, ry = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        sx, sy = f["q"]["x"] - f["p"]["x"], f["q"]["y"] - f["p"]["y"]
        qx, qy = f["p"]["x"] - e["p"]["x"], f["p"]["y"] - e["p"]["y"]
        det = rx * sy - ry * sx
        t, u = F.try_divide(qx * sy - qy * sx, det), F.try_divide(qx * ry - qy * rx, det)
        at = pt(e["p"]["x"] + t * rx, e["p"]["y"] + t * ry)
        ends = F.least(near(e["p"], f, False), near(e["q"], f, False), near(f["p"], e, True), near(f["q"], e, True))
        return F.when(t.between(0, 1) & u.between(0, 1), F.struct(F.lit(0.0).alias("d"), at.alias("p"), at.alias("q")).cast(_NEAR_T)).otherwise(ends.cast(_NEAR_T))

    best = F.aggregate(_sides(a), F.lit(None).cast(_NEAR_T), lambda s, e: F.aggregate(_sides(b), s, lambda z, f: F.least(z, between(e, f))))
    inside = lambda g, h: F.when(is_areal(h), F.get(F.filter(F.slice(points(g), 1, 1), lambda p: point_in(p, h, True)), F.lit(0)))
    held = F.coalesce(inside(a, b), inside(b, a))
    return F.when(is_empty(a) | is_empty(b), None).when(held.isNotNull(), F.struct(F.lit(0.0).alias("d"), held.alias("p"), held.alias("q")).cast(_NEAR_T)).otherwise(best)


def distance(a: Column, b: Column, strategy: str | None = None, spheroid: Spheroid = WGS84) -> Column:
    """Planar, or in metres by a strategy (haversine, andoyer, thomas, vincenty, karney) between the points
    that are nearest on the sphere, edges being great-circle arcs."""
    if strategy is None:
        return _nearest(a, b)["d"]
    pair = _called(lambda g, h: None if (c := planar.closest_on_sphere(g, h)) is None else [*c[0], *c[1]], "array<double>", a, b)
    if strategy == "haversine":
        measure = lambda p: haversine(p[0], p[1], p[2], p[3], spheroid.mean_radius)
    elif strategy in ("andoyer", "thomas"):
        measure = lambda p: getattr(spheroid, strategy)(p[0], p[1], p[2], p[3])
    elif strategy == "vincenty":
        return spheroid.vincenty(*[F.get(pair, F.lit(i)) for i in range(4)])["distance"]
    elif strategy == "karney":
        return geodesic.inverse(*[F.get(pair, F.lit(i)) for i in range(4)], spheroid)["distance"]
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return F.when(a.isNotNull() & b.isNotNull(), let(pair, measure))


def closest_points(a: Column, b: Column, geodetic: bool = False) -> Column:
    """A segment between the nearest points, planar or on the sphere."""
    if geodetic:
        return _shaped(lambda g, h: None if (c := planar.closest_on_sphere(g, h)) is None else ("segment", [[list(c)]]), a, b)
    pair = _nearest(a, b)
    return F.when(pair.isNotNull(), make("segment", F.array(F.array(F.array(pair["p"], pair["q"])))))


def convex_hull(g: Column) -> Column:
    """A ring counter-clockwise from its leftmost point, by two passes over the points in order; each new
    point drops those before it that it would leave inside (in a hull they stand at the end)."""
    ps = F.array_sort(F.array_distinct(points(g)))
    cross = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def half(p: Column) -> Column:
        add = lambda s, q: F.concat(F.filter(s, lambda v, i: (i == 0) | (cross(F.get(s, i - 1), v, q) > 0)), F.array(q))
        return F.aggregate(p, F.array().cast(T.ArrayType(POINT_T)), add)

    low, high = half(ps), half(F.reverse(ps))
    ring = F.concat(F.slice(low, F.lit(1), F.greatest(F.size(low) - 1, F.lit(0))), high)
    few = F.concat(ps, F.slice(ps, 1, 1))
    return F.when(g.isNull(), None).when(is_empty(g), make("polygon", F.array())).otherwise(polygon(F.when(F.size(ps) < 3, few).otherwise(ring)))


def simplify(g: Column, tolerance: float) -> Column:
    return _shaped(lambda x: planar.simplify(x, tolerance), g)


def buffer(g: Column, distance_: float, points_per_circle: int = 36, end: str = "round", join: str = "round", miter_limit: float = 5.0, point: str = "circle", right: float | None = None) -> Column:
    """The area within a distance; ``join`` round or miter, ``end`` round or flat, ``point`` circle or
    square, ``right`` another distance for the right of lines."""
    if join not in ("round", "miter") or end not in ("round", "flat") or point not in ("circle", "square"):
        raise ValueError("no such strategy")
    return _shaped(lambda x: planar.buffer(x, distance_, points_per_circle, end, join, miter_limit, point, right), g)


def is_simple(g: Column) -> Column:
    return _called(planar.is_simple, "boolean", g)


def is_valid(g: Column) -> Column:
    return validity(g) == ""


def validity(g: Column) -> Column:
    """The reason why a geometry is not valid, or an empty string."""
    return _called(planar.invalid, "string", g)


def intersection(a: Column, b: Column) -> Column:
    return _shaped(lambda x, y: planar.overlay(x, y, "intersection"), a, b)


def union(a: Column, b: Column) -> Column:
    return _shaped(lambda x, y: planar.overlay(x, y, "union"), a, b)


def difference(a: Column, b: Column) -> Column:
    return _shaped(lambda x, y: planar.overlay(x, y, "difference"), a, b)


# points against one polygon, as expressions
def point_in(p: Column, g: Column, boundary: bool = False) -> Column:
    """Whether a point is inside an area; on its edge counts only with ``boundary``."""
    def edges(f, start, merge):
        return F.aggregate(F.transform(lists(g), lambda r: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), start, lambda a, i: merge(a, f(F.get(r, i - 1), F.get(r, i))))), start, merge)

    cross = lambda a, b: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    on = lambda a, b: F.coalesce((cross(a, b) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])), F.lit(False))
    hit = lambda a, b: F.coalesce(((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]), F.lit(False))
    safe = lambda a, b: F.when((a["y"] > p["y"]) != (b["y"] > p["y"]), hit(a, b)).otherwise(F.lit(False))
    edge = edges(on, F.lit(False), lambda a, x: a | x)
    odd = edges(safe, F.lit(False), lambda a, x: a != x)
    return (edge | odd) if boundary else (~edge & odd)


def for_each_point(g: Column, container: Column, boundary: bool = False) -> Column:
    return F.transform(points(g), lambda p: point_in(p, container, boundary))


def for_each_point_distance(g: Column, container: Column) -> Column:
    return F.transform(points(g), lambda p: _nearest(make("point", F.array(F.array(F.array(p)))), container)["d"])
