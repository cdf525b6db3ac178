"""Overlays, relations and dissolving of polygons made from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import geometry as g
from tessera.operators import noding

from .base import register, table


def shapes(spark, sf_dir):
    """For each part an L-shaped polygon with a hole, and a diamond from its order lines."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.expr("cast(sum(l_quantity) as bigint)").alias("q"), F.count("*").alias("m"))
    d = table(spark, sf_dir, "part").join(n, F.expr("p_partkey = l_partkey")).selectExpr("p_partkey as id", "p_brand as brand", "double(p_partkey * 13 % 40) as x", "double(p_partkey * 7 % 30) as y", "double(q % 11 - 1) as dx", "double(q % 7 - 1) as dy", "double(m % 4 + 1) as r")
    x, y = F.col("x"), F.col("y")
    at = lambda *ps: F.array(*[g.pt(x + a, y + b) for a, b in ps])
    poly = g.polygon(at((0, 0), (8, 0), (8, 3), (3, 3), (3, 6), (0, 6), (0, 0)), F.array(at((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))))
    cx, cy, r = x + F.col("dx"), y + F.col("dy"), F.col("r")
    diamond = g.polygon(F.array(g.pt(cx - r, cy), g.pt(cx, cy - r), g.pt(cx + r, cy), g.pt(cx, cy + r), g.pt(cx - r, cy)))
    return d.select("id", "brand", "x", "y", "dx", "dy", "r", poly.alias("poly"), diamond.alias("diamond"))


# A quarter of a unit square, between its diagonals, is wholly inside or outside of every shape: its middle tells.
_SHAPES = """n AS (SELECT l_partkey, sum(l_quantity)::BIGINT AS q, count(*) AS m FROM lineitem GROUP BY 1),
d AS (SELECT p_partkey AS id, p_brand AS brand, p_partkey * 13 % 40 AS x, p_partkey * 7 % 30 AS y, q % 11 - 1 AS dx, q % 7 - 1 AS dy, m % 4 + 1 AS r FROM part JOIN n ON p_partkey = l_partkey),
c AS (SELECT i.i + a AS u, j.j + b AS v FROM range(-6, 16) i(i), range(-6, 12) j(j), (VALUES (0.5, 1 / 6.0), (0.5, 5 / 6.0), (1 / 6.0, 0.5), (5 / 6.0, 0.5)) o(a, b)),
l AS (SELECT u, v FROM c WHERE u > 0 AND v > 0 AND (u < 8 AND v < 3 OR u < 3 AND v < 6) AND NOT (u BETWEEN 1 AND 2 AND v BETWEEN 1 AND 2))"""
_IN_L = "u > 0 AND v > 0 AND (u < 8 AND v < 3 OR u < 3 AND v < 6) AND NOT (u BETWEEN 1 AND 2 AND v BETWEEN 1 AND 2)"
_AREAS = f"""t AS (SELECT id, count(*) FILTER ({_IN_L}) / 4.0 AS common, any_value(2.0 * r * r) AS diamond FROM d JOIN c ON abs(u - dx) + abs(v - dy) < r GROUP BY id)"""


@register(f"""WITH {_SHAPES}, {_AREAS} SELECT id, common::DOUBLE AS common, (32 + diamond - common)::DOUBLE AS both_, (32 - common)::DOUBLE AS rest, (32 + diamond - 2 * common)::DOUBLE AS apart, common::DOUBLE AS measured FROM t""")
def overlay_layers(spark, sf_dir):
    """Areas of the four overlays of a polygon and a diamond, from stitched rings; one also from pieces."""
    d = shapes(spark, sf_dir)
    both = noding.Pairs(d, ["id"], "poly", "diamond")
    out = both.overlays("intersection", "union", "difference", "symmetric_difference", of=lambda c: F.round(g.area(c), 6))
    out = out.toDF("id", "common", "both_", "rest", "apart")
    return out.join(both.area().select("id", F.round("area", 6).alias("measured")), "id")


@register(f"""WITH {_SHAPES}, {_AREAS} SELECT id, common > 0 AND common < 32 AND common < diamond AS overlaps, common = diamond AS holds, common > 0 AS share_ FROM t""")
def overlay_relations(spark, sf_dir):
    r = noding.relations(shapes(spark, sf_dir), ["id"], "diamond", "poly")
    p = lambda n: noding.predicate(n, F.col("relation"), F.col("dim_a"), F.col("dim_b"))
    return r.select("id", p("overlaps").alias("overlaps"), p("covered_by").alias("holds"), noding.matches(F.col("relation"), "T********").alias("share_"))


@register(f"""WITH {_SHAPES} SELECT brand, count(DISTINCT (floor(x + u), floor(y + v)))::DOUBLE AS area, count(DISTINCT id) AS shapes FROM d, l GROUP BY brand""")
def overlay_dissolved(spark, sf_dir):
    """The polygons of each brand as one."""
    d = shapes(spark, sf_dir)
    out = noding.dissolve(d, ["brand"], "poly").select("brand", F.round(g.area(F.col("geometry")), 6).alias("area"))
    return out.join(d.groupBy("brand").agg(F.count("*").alias("shapes")), "brand")


@register(f"""WITH {_SHAPES}, p AS (SELECT n_nationkey AS k, n_nationkey * 13 % 40 AS px, n_nationkey * 7 % 30 AS py FROM nation), near AS (SELECT id, k, dx + x - px AS ax, dy + y - py AS ay, r FROM d JOIN p ON abs(x + dx - px - 4) < 12 AND abs(y + dy - py - 3) < 11),
a AS (SELECT id, k, count(*) / 4.0 AS common, any_value(2.0 * r * r) AS diamond FROM near JOIN l ON abs(u - ax) + abs(v - ay) < r GROUP BY 1, 2) SELECT id, k FROM a WHERE common < 32 AND common < diamond""")
def spatial_join_overlaps(spark, sf_dir):
    """Diamonds and polygons that overlap: a join by tiles, then relations of the pairs that are near."""
    ring = lambda *ps: F.array(*[g.pt(F.col("x") + a, F.col("y") + b) for a, b in ps])
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "double(n_nationkey * 13 % 40) as x", "double(n_nationkey * 7 % 30) as y")
    n = n.select("k", g.polygon(ring((0, 0), (8, 0), (8, 3), (3, 3), (3, 6), (0, 6), (0, 0)), F.array(ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1)))).alias("poly"))
    return g.spatial_join(shapes(spark, sf_dir).select("id", "diamond"), n, "diamond", "poly", "overlaps").select("id", "k")
