"""Overlay, relation and dissolving of shapes as joins and aggregates over their noded edges.

No task sees two whole shapes. Edges of all shapes of a key are dealt to square tiles, as many as there
are edges; where edges of one tile meet, both are cut, and an ordered pass along each edge gives its
pieces. Equal pieces of several edges become one, with the sum of their directions (an area is on the
left of its edges) for the left and the right shape. How often a shape covers the place beside a piece
is the sum of the directions of the pieces above it, found by an equality of upright strips. So each
piece knows what lies on both its sides, and

- an overlay keeps the pieces whose sides differ in the wanted set and stitches them to rings, which
  are found by pointer doubling: in as many rounds as the binary digits of the number of pieces. Keys of
  at most ``block`` pieces double inside a task, many keys at once; larger ones by joins;
- a relation (DE-9IM) is the greatest dimension by part of both shapes, over pieces and nodes.

Coordinates are rounded to a grid of ``grid`` units, where they are whole numbers, so that nodes meet by
equality; what is nearer than one unit of the grid counts as touching. Areas may meet themselves: a
place is inside where the directions around it don't cancel out.

Tables of pieces are small as files and large in memory, so no join of them is left to broadcasting,
which would take them through the driver: all are sort-merge joins.

Defined cases: a NULL shape, or one with a coordinate that is not finite or beyond 2 ** 51 units of the
grid, gives NULL; empty shapes give empty ones, and no common part; keys must be unique and are given
back as they are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import saved

from . import geometry as geo

#: About 1e-9: degrees to a tenth of a millimetre
GRID = 2.0**-30
#: Most pieces of a key that one task stitches
BLOCK = 50_000
LINEAR = ("segment", "linestring", "multilinestring")
PIECE = ["lx", "ly", "hx", "hy"]


def dimension(g: Column) -> Column:
    return F.when(geo.is_areal(g), 2).when(g["kind"].isin(*LINEAR), 1).otherwise(0)


def sound(g: Column, grid: float = GRID) -> Column:
    """Whether a shape can be put on the grid; NULL of NULL."""
    most = 2.0**51 * grid
    return F.when(g.isNotNull(), F.forall(geo.points(g), lambda p: F.coalesce((F.abs(p["x"]) < most) & (F.abs(p["y"]) < most), F.lit(False))))


def _edges(shapes: DataFrame, grid: float) -> DataFrame:
    """shapes: k, side, part, g. A row for each edge, in grid units; a point is an edge without length."""
    g = geo.correct(F.col("g"))
    steps = lambda r: F.filter(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: i < F.size(r))
    along = F.flatten(F.transform(geo.lists(g), lambda r: F.transform(steps(r), lambda i: F.struct(F.get(r, i - 1).alias("p"), F.get(r, i).alias("q")))))
    lone = F.transform(geo.points(g), lambda p: F.struct(p.alias("p"), p.alias("q")))
    d = shapes.select("k", "side", "part", dimension(F.col("g")).alias("dim"), F.posexplode(F.when(dimension(F.col("g")) == 0, lone).otherwise(along)).alias("i", "e"))
    whole = lambda c: F.round(F.col(c) / grid).cast("long")
    d = d.select("k", "side", "part", "dim", "i", whole("e.p.x").alias("ax"), whole("e.p.y").alias("ay"), whole("e.q.x").alias("bx"), whole("e.q.y").alias("by"), F.lit(1).cast("long").alias("d"))
    return d.where("dim = 0 or ax <> bx or ay <> by")


def _tiled(edges: DataFrame) -> DataFrame:
    """Edges by the tiles that they run through."""
    span = edges.groupBy("k").agg(F.expr("ceil(sqrt(count(*)))").alias("n"), F.expr("greatest(max(greatest(ax, bx)) - min(least(ax, bx)), max(greatest(ay, by)) - min(least(ay, by)))").alias("d"))
    d = edges.hint("merge").join(span.select("k", F.expr("greatest(ceil(d / n), 8)").alias("tile")), "k")
    d = d.withColumn("tx", F.explode(F.expr("sequence(floor((least(ax, bx) - 1) / tile), floor((greatest(ax, bx) + 1) / tile))")))
    at = "if(ax = bx, {end}, ay + (by - ay) * ((greatest(least({x}, greatest(ax, bx)), least(ax, bx)) - ax) / (bx - ax)))"
    lo, hi = at.format(x="tx * tile - 1", end="ay"), at.format(x="(tx + 1) * tile + 1", end="by")
    return d.withColumn("ty", F.explode(F.expr(f"sequence(floor((least({lo}, {hi}) - 1) / tile), floor((greatest({lo}, {hi}) + 1) / tile))"))).drop("tile")


_EDGE = ["side", "part", "dim", "i", "ax", "ay", "bx", "by", "d"]


def _merged(edges: DataFrame) -> DataFrame:
    """Equal edges of areas of a side as one that runs upwards, ``d`` times; those that cancel out bound nothing."""
    up = edges.withColumn("up", F.expr("ax < bx or (ax = bx and ay < by)"))
    up = up.selectExpr("k", "side", "dim", "if(up, ax, bx) as ax", "if(up, ay, by) as ay", "if(up, bx, ax) as bx", "if(up, by, ay) as by", "if(up, d, -d) as d")
    one = up.groupBy("k", "side", "dim", "ax", "ay", "bx", "by").agg(F.sum("d").alias("d")).where("d <> 0")
    return one.withColumn("part", F.lit(0).cast("long")).withColumn("i", F.monotonically_increasing_id()).select("k", *_EDGE)


def _cuts(edges: DataFrame) -> DataFrame:
    """Points where edges meet others, for each of both edges."""
    t = _tiled(edges).select("k", "tx", "ty", F.struct(*_EDGE).alias("e"))
    j = t.withColumnRenamed("e", "a").hint("merge").join(t.withColumnRenamed("e", "b"), ["k", "tx", "ty"]).where("(a.side, a.part, a.i) < (b.side, b.part, b.i)")
    j = j.where("greatest(a.ax, a.bx) + 1 >= least(b.ax, b.bx) and greatest(b.ax, b.bx) + 1 >= least(a.ax, a.bx) and greatest(a.ay, a.by) + 1 >= least(b.ay, b.by) and greatest(b.ay, b.by) + 1 >= least(a.ay, a.by)")
    j = j.selectExpr("k", "a", "b", "double(a.bx - a.ax) as rx", "double(a.by - a.ay) as ry", "double(b.bx - b.ax) as sx", "double(b.by - b.ay) as sy", "double(b.ax - a.ax) as qx", "double(b.ay - a.ay) as qy")

    def near(px: str, py: str, x: str, y: str) -> str:
        """Whether (px, py), from the start of an edge (x, y), is on it."""
        t = f"if({x} = 0 and {y} = 0, 0, greatest(0, least(1, (({px}) * {x} + ({py}) * {y}) / ({x} * {x} + {y} * {y}))))"
        return f"hypot({px} - {t} * {x}, {py} - {t} * {y}) <= 1"

    j = j.selectExpr("*", f"{near('qx', 'qy', 'rx', 'ry')} as ca", f"{near('(qx + sx)', '(qy + sy)', 'rx', 'ry')} as da", f"{near('-qx', '-qy', 'sx', 'sy')} as ab", f"{near('(rx - qx)', '(ry - qy)', 'sx', 'sy')} as bb", "rx * sy - ry * sx as det")
    j = j.withColumn("through", F.expr("not (ca or da or ab or bb) and abs(det) > 1e-12 * hypot(rx, ry) * hypot(sx, sy)"))
    j = j.selectExpr("*", "if(through, (qx * sy - qy * sx) / det, -1) as t", "if(through, (qx * ry - qy * rx) / det, -1) as u")
    j = j.withColumn("through", F.expr("through and t > 0 and t < 1 and u > 0 and u < 1"))
    j = j.selectExpr("*", "if(through, a.ax + bigint(round(t * rx)), null) as x", "if(through, a.ay + bigint(round(t * ry)), null) as y")
    hits = "filter(array(if(ca, struct(a as e, b.ax as x, b.ay as y), null), if(da, struct(a as e, b.bx as x, b.by as y), null), if(ab, struct(b as e, a.ax as x, a.ay as y), null), if(bb, struct(b as e, a.bx as x, a.by as y), null), if(through, struct(a as e, x, y), null), if(through, struct(b as e, x, y), null)), h -> h is not null)"
    return j.selectExpr("k", f"explode({hits}) as h").selectExpr("k", "h.e.*", "h.x as x", "h.y as y")


class Noded:
    """The noded edges of shapes (k, side, part, g), as written tables: ``edges``, ``nodes``, the course of each edge
    from node to node, and ``bare``, the distinct pieces. With ``merge`` (areas only) equal edges are noded once."""

    def __init__(self, shapes: DataFrame, grid: float = GRID, merge: bool = False):
        self.grid = grid
        edges = _edges(shapes, grid)
        self.edges = saved(_merged(edges) if merge else edges)
        own = ["k", *_EDGE]
        cuts = _cuts(self.edges).select(*own, "x", "y")
        ends = self.edges.select(*own, F.explode(F.expr("array(struct(ax as x, ay as y), struct(bx as x, by as y))")).alias("p")).select(*own, "p.x", "p.y")
        w = Window.partitionBy("k", "side", "part", "i").orderBy("far", "x", "y")
        far = F.expr("double(x - ax) * double(bx - ax) + double(y - ay) * double(by - ay)")
        run = ends.union(cuts).withColumn("far", far).select("*", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
        run = run.where("nx is null or x <> nx or y <> ny")  # edges that share several tiles meet in each
        self.nodes = saved(run.select("k", "side", "part", "dim", "i", "far", "x", "y", "nx", "ny", "d"))
        run = self.nodes.where("dim > 0 and nx is not null")
        run = run.withColumn("up", F.expr("x < nx or (x = nx and y < ny)"))
        run = run.selectExpr("k", "side", "dim", "if(up, x, nx) as lx", "if(up, y, ny) as ly", "if(up, nx, x) as hx", "if(up, ny, y) as hy", "if(up, d, -d) as d")
        sums = [F.expr(f"sum(if(side = {s} and dim = 2, d, 0))").alias(f"w{s}") for s in (0, 1)]
        flags = [F.expr(f"bool_or(side = {s} and dim = {dim})").alias(f"{n}{s}") for s in (0, 1) for n, dim in (("area", 2), ("line", 1))]
        self.bare = saved(run.groupBy("k", *PIECE).agg(*sums, *flags))

    def covered(self, probes: DataFrame, names: list[str]) -> DataFrame:
        """``probes`` (k, names, mx, my) with c0, c1: how often the areas of each side cover the place
        just above, and if an upright edge is there, to its right."""
        span = self.bare.groupBy("k").agg(F.expr("bigint(greatest(ceil((max(hx) - min(lx)) / ceil(count(*) / 4)), 1))").alias("strip"))
        e = self.bare.where("lx < hx and (w0 <> 0 or w1 <> 0)").hint("merge").join(span, "k").withColumn("c", F.explode(F.expr("sequence(floor(lx / strip), floor((hx - 1) / strip))")))
        e = e.select(F.col("k").alias("ek"), "c", *[F.col(n).alias(f"e{n}") for n in PIECE], "w0", "w1").withColumnRenamed("c", "ec")
        p = probes.hint("merge").join(span, "k").withColumn("c", F.expr("floor(mx / strip)"))
        on = F.expr("k = ek and c = ec and elx <= mx and mx < ehx and ely + (ehy - ely) * ((mx - elx) / (ehx - elx)) > my")
        return p.hint("merge").join(e, on, "left").groupBy("k", *names).agg(*[F.expr(f"-coalesce(sum(w{s}), 0)").alias(f"c{s}") for s in (0, 1)])

    def sided(self) -> DataFrame:
        """Pieces with l0, l1 and r0, r1: how often each side's areas cover the left and the right of
        them, seen from their lower end (lx, ly)."""
        probes = self.bare.selectExpr("k", *PIECE, "if(lx = hx, double(lx), (lx + hx) / 2) as mx", "(ly + hy) / 2 as my")
        d = self.bare.hint("merge").join(self.covered(probes, PIECE), ["k", *PIECE])
        sides = [f"if(lx = hx, c{s} + w{s}, c{s}) as l{s}" for s in (0, 1)] + [f"if(lx = hx, c{s}, c{s} - w{s}) as r{s}" for s in (0, 1)]
        return d.selectExpr("*", *sides)


HOW = {
    "intersection": "{0} <> 0 and {1} <> 0",
    "union": "({0} <> 0 or {1} <> 0)",
    "difference": "{0} <> 0 and {1} = 0",
    "symmetric_difference": "({0} <> 0) <> ({1} <> 0)",
}


def _stitched(bounds: DataFrame, block: int) -> DataFrame:
    """bounds: k, ax, ay, bx, by, the wanted area on their left. (k, e, ring, place): each piece with the
    least piece of its ring, and its order along it."""
    size = bounds.groupBy("k").count()
    sized = saved(bounds.hint("merge").join(size, "k"))
    kind = bounds.schema["k"].dataType.simpleString()

    def run(frames):
        for pdf in _whole_keys(frames):
            ring, place = rings_of(*(pdf[c].to_numpy(np.int64) for c in ("id", "ax", "ay", "bx", "by")))
            first = {f"r{c}": pdf[c].to_numpy(np.int64)[ring] for c in ("ax", "ay", "bx", "by")}
            yield pdf[["k", "ax", "ay", "bx", "by"]].assign(**first, place=place)

    near = sized.where(F.col("count") <= block).select("k", "ax", "ay", "bx", "by").repartition("k").sortWithinPartitions("k")
    out = near.mapInPandas(run, f"k {kind}, ax bigint, ay bigint, bx bigint, by bigint, rax bigint, ray bigint, rbx bigint, rby bigint, place bigint")
    out = out.selectExpr("k", "struct(ax, ay, bx, by) as e", "struct(rax as ax, ray as ay, rbx as bx, rby as by) as ring", "place")
    wide = sized.where(F.col("count") > block)
    if not wide.isEmpty():
        out = out.union(_stitched_wide(wide.drop("count")))
    return saved(out)


def _whole_keys(frames):
    """Frames of whole keys, about 100,000 rows of them at once, numbered in ``id``; rows come by key."""
    held, rows, last, n = [], 0, None, 0
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf["k"].to_numpy()
        ids = n + np.cumsum(np.r_[last is None or k[0] != last, k[1:] != k[:-1]])
        n, last = ids[-1], k[-1]
        pdf = pdf.assign(id=ids)
        if rows > 100_000 and ids[0] != held[-1]["id"].iloc[-1]:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
        held.append(pdf)
        rows += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def rings_of(k, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the row of the least piece of its ring, and its order along it."""
    n = len(k)
    order = np.lexsort((by, bx, ay, ax, k))  # by start
    starts = np.stack([k, ax, ay], 1)[order]
    new = np.r_[True, (starts[1:] != starts[:-1]).any(1)]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.diff(np.r_[first, n])
    # the group of each piece's end
    nodes = starts[first]
    both = np.concatenate([nodes, np.stack([k, bx, by], 1)])
    _, inverse = np.unique(both, axis=0, return_inverse=True)
    at = np.full(inverse.max() + 1, -1)
    at[inverse[: len(nodes)]] = np.arange(len(nodes))
    end = at[inverse[len(nodes) :]]
    # the sharpest left turn among the pieces that start there
    rows = np.repeat(np.arange(n), many[end])
    place = np.arange(len(rows)) - np.repeat(np.cumsum(many[end]) - many[end], many[end])
    ways = order[first[end[rows]] + place]
    back = np.arctan2((ay - by)[rows].astype(float), (ax - bx)[rows].astype(float))
    turn = np.mod(back - np.arctan2((by - ay)[ways].astype(float), (bx - ax)[ways].astype(float)), 2 * np.pi)
    turn = np.where(turn > 1e-12, turn, 2 * np.pi)
    best = np.lexsort((turn, rows))
    follow = ways[best[np.r_[True, np.diff(rows[best]) > 0]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ring, place = _doubled(follow, rank)
    # a ring that comes back to a node falls into simple ones
    passes = np.lexsort((place, group[rank], ring))
    same = (ring[passes][1:] == ring[passes][:-1]) & (group[rank][passes][1:] == group[rank][passes][:-1])
    if same.any():
        start = np.flatnonzero(np.r_[True, ~same])
        length = np.diff(np.r_[start, n])
        before = np.arange(n) - 1
        before[start] = start + length - 1
        swap = np.empty(n, np.int64)
        swap[passes] = passes[before]
        ring, place = _doubled(swap[follow], rank)
    return ring, place


def _doubled(follow: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of least rank on each row's cycle, and the order along the cycle from there."""
    n = len(follow)
    least, off, to = np.arange(n), np.zeros(n, np.int64), follow.copy()
    for r in range(max(n - 1, 0).bit_length()):
        better = rank[least[to]] < rank[least]
        off = np.where(better, off[to] + (1 << r), off)
        least = np.where(better, least[to], least)
        to = to[to]
    return least, np.where(off == 0, 0, (1 << 62) - off)


def _stitched_wide(bounds: DataFrame) -> DataFrame:
    """The same by joins, a round of doubling each."""
    e = bounds.select("k", F.struct("ax", "ay", "bx", "by").alias("e"))
    back = "atan2(double(e.ay - e.by), double(e.ax - e.bx))"
    out = "atan2(double(o.by - o.ay), double(o.bx - o.ax))"
    ways = e.selectExpr("k as ok", "e as o")
    turn = F.expr(f"pmod({back} - {out}, 2 * pi())")  # clockwise from where it came: the sharpest left turn first
    follow = e.hint("merge").join(ways, F.expr("k = ok and e.bx = o.ax and e.by = o.ay")).withColumn("turn", F.when(turn > 1e-12, turn).otherwise(2 * math.pi))
    follow = saved(follow.groupBy("k", "e").agg(F.min_by("o", "turn").alias("ptr")))
    rings = _ranked(follow)
    # a ring that comes back to a node falls into simple ones: each pass ends with what the one before began
    w = Window.partitionBy("k", "ring", "e.ax", "e.ay")
    again = rings.withColumn("n", F.count("*").over(w)).where("n > 1")
    order = w.orderBy("place")
    swap = again.select(F.col("k").alias("sk"), F.col("e").alias("was"), F.coalesce(F.lag("e").over(order), F.last("e").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("new"))
    swap = saved(swap)
    if swap.isEmpty():
        return rings
    return _ranked(saved(follow.hint("merge").join(swap, F.expr("k = sk and ptr = was"), "left").select("k", "e", F.coalesce("new", "ptr").alias("ptr"))))


def _ranked(follow: DataFrame) -> DataFrame:
    """(k, e, ring, place) by doubling: after n rounds each piece knows the least of the 2 ** n that
    follow, and how far it is."""
    most = follow.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    d = follow.select("k", "e", "ptr", F.col("e").alias("m"), F.lit(0).cast("long").alias("off"))
    for r in range(max(most - 1, 0).bit_length()):
        far = d.select(F.col("k").alias("fk"), F.col("e").alias("fe"), F.col("ptr").alias("fptr"), F.col("m").alias("fm"), F.col("off").alias("foff"))
        d = d.hint("merge").join(far, F.expr("k = fk and ptr = fe")).selectExpr("k", "e", "fptr as ptr", "least(m, fm) as m", f"if(fm < m, foff + {1 << r}L, off) as off")
        d = saved(d)
    return d.selectExpr("k", "e", "m as ring", "if(off = 0, 0L, 4611686018427387904L - off) as place")


def _homes(rings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k, ring, home) of holes: the outer ring around each. A piece that has the area above it and the
    nearest piece over its middle bound the same part of the area, so their rings belong together; outer
    rings hand their name on along these links, a step each round."""
    span = rings.groupBy("k").agg(F.expr("bigint(greatest(ceil((max(e.bx) - min(e.ax)) / ceil(count(*) / 4)), 1))").alias("strip"))
    d = rings.hint("merge").join(span, "k").selectExpr("k as ek", "ring as ering", "strip", "least(e.ax, e.bx) as lx", "greatest(e.ax, e.bx) as hx", "if(e.ax < e.bx, e.ay, e.by) as ly", "if(e.ax < e.bx, e.by, e.ay) as hy").where("lx < hx")
    d = d.withColumn("ec", F.explode(F.expr("sequence(floor(lx / strip), floor((hx - 1) / strip))"))).drop("strip")
    one = rings.where("e.bx > e.ax").hint("merge").join(span, "k").selectExpr("k", "ring", "e", "(e.ax + e.bx) / 2 as mx", "(e.ay + e.by) / 2 as my", "strip").withColumn("c", F.expr("floor(mx / strip)"))
    y = "ly + (hy - ly) * ((mx - lx) / (hx - lx))"
    over = one.hint("merge").join(d, F.expr(f"k = ek and c = ec and lx <= mx and mx < hx and {y} > my")).groupBy("k", "ring", "e").agg(F.min_by("ering", F.expr(y)).alias("other")).where("ring <> other")
    links = saved(over.select("k", F.explode(F.expr("array(struct(ring as a, other as b), struct(other as a, ring as b))")).alias("l")).select("k", "l.a", "l.b").distinct())
    named = saved(sizes.where("area > 0").select("k", "ring", F.col("ring").alias("home")))
    holes = sizes.where("area < 0").select("k", "ring")
    while True:
        rest = holes.hint("merge").join(named.select("k", "ring"), ["k", "ring"], "left_anti")
        if rest.isEmpty():
            return named.hint("merge").join(holes, ["k", "ring"], "left_semi")
        told = links.hint("merge").join(named.select("k", F.col("ring").alias("a"), "home"), ["k", "a"]).groupBy("k", F.col("b").alias("ring")).agg(F.min("home").alias("home"))
        new = saved(told.hint("merge").join(rest, ["k", "ring"], "left_semi"))
        if new.isEmpty():
            raise RuntimeError("a hole has no outer ring")
        named = named.union(new)


def areas(bounds: DataFrame, grid: float, block: int = BLOCK) -> DataFrame:
    """(k, parts): members of a multipolygon, each an outer ring with its holes, from their edges."""
    rings = _stitched(bounds, block)
    first = F.expr("aggregate(sequence(1, size(p)), 0.0D, (a, i) -> a + double(get(p, i - 1).x - p[0].x) * double(get(p, i % size(p)).y - p[0].y) - double(get(p, i % size(p)).x - p[0].x) * double(get(p, i - 1).y - p[0].y))")
    lines = rings.groupBy("k", "ring").agg(F.expr("transform(sort_array(collect_list(struct(place, e.ax as x, e.ay as y))), q -> struct(q.x as x, q.y as y))").alias("p")).withColumn("area", first)
    lines = saved(lines.where("area <> 0"))
    # without points inside straight runs
    bend = "abs(double(q.x - get(p, pmod(i - 1, size(p))).x) * double(get(p, (i + 1) % size(p)).y - q.y) - double(q.y - get(p, pmod(i - 1, size(p))).y) * double(get(p, (i + 1) % size(p)).x - q.x))"
    chord = "hypot(double(get(p, (i + 1) % size(p)).x - get(p, pmod(i - 1, size(p))).x), double(get(p, (i + 1) % size(p)).y - get(p, pmod(i - 1, size(p))).y))"
    shown = lines.withColumn("p", F.expr(f"filter(p, (q, i) -> {bend} > {chord})")).where("size(p) > 2")
    shown = shown.withColumn("p", F.expr(f"transform(concat(p, slice(p, 1, 1)), q -> struct(double(q.x) * {grid!r}D as x, double(q.y) * {grid!r}D as y))"))
    full = shown.where("area > 0").selectExpr("k", "ring", "array(p) as member")
    if lines.where("area < 0").isEmpty():
        return full.groupBy("k").agg(F.expr("transform(sort_array(collect_list(struct(ring, member))), m -> m.member)").alias("parts"))
    home = _homes(rings, lines)
    holes = shown.where("area < 0").hint("merge").join(home, ["k", "ring"]).groupBy("k", "home").agg(F.expr("transform(sort_array(collect_list(struct(ring, p))), h -> h.p)").alias("holes")).withColumnRenamed("home", "ring")
    full = shown.where("area > 0").hint("merge").join(holes, ["k", "ring"], "left").selectExpr("k", "ring", "concat(array(p), coalesce(holes, array())) as member")
    return full.groupBy("k").agg(F.expr("transform(sort_array(collect_list(struct(ring, member))), m -> m.member)").alias("parts"))


def _digest(*shapes: Column) -> Column:
    return F.xxhash64(*shapes, *[g.isNull() for g in shapes])


def _pairs(df: DataFrame, keys: list[str], a: str, b: str, grid: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All keys with the number ``k`` of their pair of shapes, equal pairs having one; all pairs with whether
    both shapes are sound; and the sound shapes by side."""
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("key"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
    d = saved(d.withColumn("digest", _digest(F.col("a"), F.col("b"))))
    one = saved(d.select("digest", "a", "b").distinct().withColumn("k", F.monotonically_increasing_id()))
    if one.groupBy("digest").count().where("count > 1").isEmpty():
        given = d.select("key", "digest").hint("merge").join(one.select("digest", "k"), "digest")
    else:  # digests that collide do not decide
        given = d.toDF("key", "ka", "kb", "told").hint("merge").join(one, F.expr("told = digest and ka <=> a and kb <=> b"))
    fine = F.coalesce(sound(F.col("a"), grid) & sound(F.col("b"), grid), F.lit(False))
    shapes = one.where(fine).select("k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("g")), F.struct(F.lit(1).alias("side"), F.col("b").alias("g")))).alias("s"))
    rows = one.select("k", fine.alias("fine"), *[dimension(F.col(s)).alias(f"dim_{s}") for s in "ab"])
    return saved(given.select("key", "k")), saved(rows), shapes.select("k", "s.side", F.lit(0).cast("long").alias("part"), "s.g")


def _bounds(pieces: DataFrame, *hows: str) -> DataFrame:
    """(k, how, ax, ay, bx, by): pieces whose sides differ in a wanted set, that set on their left."""
    one = lambda how: (HOW[how].format("l0", "l1"), HOW[how].format("r0", "r1"))
    kept = [F.expr(f"if(({x}) <> ({y}), struct('{how}' as how, ({x}) as up), null)") for how, (x, y) in ((h, one(h)) for h in hows)]
    d = pieces.select("k", *PIECE, F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())).alias("w"))
    return d.selectExpr("k", "w.how", "if(w.up, lx, hx) as ax", "if(w.up, ly, hy) as ay", "if(w.up, hx, lx) as bx", "if(w.up, hy, ly) as by")


def _parts_of(df: DataFrame) -> DataFrame:
    return df.withColumn("parts", F.coalesce(F.col("parts"), F.array().cast(geo.PARTS_T)))


class Pairs:
    """Two shapes a row, noded once for all that is asked of them; rows of equal shapes share it."""

    def __init__(self, pairs: DataFrame, keys: list[str], a: str, b: str, grid: float = GRID, block: int = BLOCK):
        self.grid, self.block = grid, block
        self.keys, self.rows, self.shapes = _pairs(pairs, keys, a, b, grid)
        self.noded = Noded(self.shapes, grid)
        self.pieces = saved(self.noded.sided())

    def each(self, found: DataFrame) -> DataFrame:
        """What was found of the pairs ``k``, for the keys of all rows."""
        return self.keys.hint("merge").join(found, "k").select("key.*", *[F.col(f"`{c}`") for c in found.columns if c != "k"])

    def overlay(self, how: str = "intersection") -> DataFrame:
        """(keys, geometry): a multipolygon of two areas for each row; of a line and an area or line,
        what is within (intersection) or outside (difference) as a multilinestring; else NULL."""
        return self.overlays(how).withColumnRenamed(how, "geometry")

    def overlays(self, *hows: str, of=lambda g: g) -> DataFrame:
        """(keys, a column for each of ``hows``): several overlays, stitched at once, or what ``of`` makes of
        them, once for equal pairs."""
        for how in hows:
            if how not in HOW:
                raise ValueError(f"no overlay {how!r}")
        names = F.array(*[F.lit(how) for how in HOW])
        flat = self.pieces.hint("merge").join(self.rows.where("dim_a = 2 and dim_b = 2").select("k"), "k", "left_semi")
        found = areas(_bounds(flat, *hows).select((F.col("k") * len(HOW) + F.array_position(names, F.col("how")) - 1).alias("k"), "ax", "ay", "bx", "by"), self.grid, self.block)
        found = found.select(F.expr(f"k div {len(HOW)}").alias("k"), F.get(names, (F.col("k") % len(HOW)).cast("int")).alias("how"), F.lit("multipolygon").alias("kind"), "parts")
        lines = {how: F.expr("dim_a = 1 and dim_b > 0" + (" or dim_a = 2 and dim_b = 1" if how == "intersection" else "")) for how in hows if how in ("intersection", "difference")}
        for how, on in lines.items():
            mixed = self.rows.where("fine").where(on).select("k", F.expr("if(dim_a = 1, 0, 1)").alias("own"))
            cut = _lines(self.noded, self.pieces, mixed, how).selectExpr("k", f"'{how}' as how", "'multilinestring' as kind", "parts")
            found = found.union(cut)
        each = [F.first(F.expr(f"if(how = '{how}', struct(kind, parts), null)"), True).alias(how) for how in hows]
        out = self.rows.hint("merge").join(found.groupBy("k").agg(*each), "k", "left")
        none = F.struct(F.when(F.expr("dim_a = 2 and dim_b = 2"), "multipolygon").otherwise("multilinestring").alias("kind"), F.array().cast(geo.PARTS_T).alias("parts"))
        made = {how: F.col("fine") & (F.expr("dim_a = 2 and dim_b = 2") | lines.get(how, F.lit(False))) for how in hows}
        return self.each(out.select("k", *[of(F.when(made[how], F.coalesce(F.col(how), none))).alias(how) for how in hows]))

    def area(self, how: str = "intersection") -> DataFrame:
        """(keys, area) of an overlay of areas, from its pieces, without rings."""
        b = _bounds(self.pieces, how)
        first = b.groupBy("k").agg(F.min("ax").alias("x"), F.min("ay").alias("y"))
        cross = "double(ax - x) * double(by - y) - double(bx - x) * double(ay - y)"
        got = b.hint("merge").join(first, "k").groupBy("k").agg((F.sum(F.expr(cross)) / 2 * self.grid**2).alias("area"))
        return self.each(self.rows.hint("merge").join(got, "k", "left").select("k", F.when(F.col("fine"), F.coalesce("area", F.lit(0.0))).alias("area")))

    def relations(self) -> DataFrame:
        """(keys, relation, dim_a, dim_b): the nine characters of the DE-9IM matrix of two shapes of any
        kind, and their dimensions."""
        return _related(self)


def overlay(pairs: DataFrame, keys: list[str], a: str, b: str, how: str = "intersection", grid: float = GRID, block: int = BLOCK) -> DataFrame:
    return Pairs(pairs, keys, a, b, grid, block).overlay(how)


def relations(pairs: DataFrame, keys: list[str], a: str, b: str, grid: float = GRID) -> DataFrame:
    return Pairs(pairs, keys, a, b, grid).relations()


def _lines(noded: Noded, pieces: DataFrame, mixed: DataFrame, how: str) -> DataFrame:
    """(k, parts): of the line on the side ``own``, the pieces in or outside the other shape, joined
    where one follows the other."""
    run = noded.nodes.where("dim = 1 and nx is not null and (x <> nx or y <> ny)").hint("merge").join(mixed, "k").where("side = own")
    run = run.withColumn("up", F.expr("x < nx or (x = nx and y < ny)"))
    run = run.selectExpr("k", "own", "part", "i", "far", "x", "y", "nx", "ny", "if(up, x, nx) as lx", "if(up, y, ny) as ly", "if(up, nx, x) as hx", "if(up, ny, y) as hy").hint("merge").join(pieces, ["k", *PIECE])
    within = F.expr("if(own = 0, line1 or area1 or l1 <> 0, line0 or area0 or l0 <> 0)")
    kept = run.where(within if how == "intersection" else ~within)
    w = Window.partitionBy("k", "part").orderBy("i", "far")
    broken = F.coalesce((F.lag("nx").over(w) != F.col("x")) | (F.lag("ny").over(w) != F.col("y")), F.lit(True))
    kept = kept.withColumn("new", broken.cast("int")).withColumn("run", F.sum("new").over(w))
    g = noded.grid
    line = F.expr(f"transform(sort_array(collect_list(struct(i, far, x, y))), q -> struct(double(q.x) * {g!r}D as x, double(q.y) * {g!r}D as y))")
    end = F.expr(f"max_by(struct(double(nx) * {g!r}D as x, double(ny) * {g!r}D as y), struct(i, far))")
    lines = kept.groupBy("k", "part", "run").agg(line.alias("p"), end.alias("q")).select("k", "run", F.concat("p", F.array("q")).alias("p"))
    return lines.groupBy("k").agg(F.expr("transform(sort_array(collect_list(struct(run, p))), m -> array(m.p))").alias("parts"))


def dissolve(shapes: DataFrame, keys: list[str], geometry: str, grid: float = GRID, block: int = BLOCK) -> DataFrame:
    """(keys, geometry): the union of all areas of each key, a multipolygon. NULL shapes and those that
    are not sound are left out; equal shapes of a key count once."""
    d = shapes.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("k"), F.col(f"`{geometry}`").alias("g")).distinct()
    d = saved(d.withColumn("part", F.monotonically_increasing_id()))
    sides = d.where(F.coalesce(sound(F.col("g"), grid), F.lit(False)) & geo.is_areal(F.col("g"))).select("k", F.lit(0).alias("side"), "part", "g")
    found = areas(_bounds(Noded(sides, grid, merge=True).sided(), "union").drop("how"), grid, block)
    out = _parts_of(d.select("k").distinct().hint("merge").join(found, "k", "left"))
    return out.select("k.*", F.struct(F.lit("multipolygon").alias("kind"), "parts").alias("geometry"))


# relations


def _related(p: Pairs) -> DataFrame:
    rows, shapes, noded = p.rows, p.shapes, p.noded
    pieces = p.pieces.hint("merge").join(rows.select("k", "dim_a", "dim_b"), "k")

    def place(own: int) -> str:
        """Of a piece of the side ``own``, where it is in the other shape: 0 inside, 1 boundary, 2 outside."""
        o = 1 - own
        # beside an area's edges both sides are alike; where the other shape's edge runs too, it is its boundary
        return f"if(area{o}, if(w{o} <> 0, 1, if(l{o} <> 0, 0, 2)), if(line{o} or l{o} <> 0, 0, 2))"

    found = []
    for own, d_own, d_other in ((0, "dim_a", "dim_b"), (1, "dim_b", "dim_a")):
        o = 1 - own
        put = (lambda i, j, d: f"struct({i} as i, {j} as j, {d} as d)") if own == 0 else (lambda i, j, d: f"struct({j} as i, {i} as j, {d} as d)")
        mine = pieces.where(f"area{own} and w{own} <> 0 or line{own}").selectExpr("k", f"explode(array({put(f'if(area{own}, 1, 0)', place(own), 1)})) as m")
        found.append(mine)
        # areas on both sides of every edge
        sides = [put(f"if({s}{own} <> 0, 0, 2)", f"if({s}{o} <> 0, 0, 2)", 2) for s in "lr"]
        found.append(pieces.where(f"area{own} and {d_other} = 2").selectExpr("k", f"explode(array({', '.join(sides)})) as m"))
        found.append(rows.where(f"fine and {d_own} = 2 and {d_other} < 2").selectExpr("k", f"{put(0, 2, 2)} as m"))
    found.append(_at_nodes(noded, rows, shapes))
    m = found[0]
    for f in found[1:]:
        m = m.union(f)
    cells = [F.coalesce(F.max(F.when((F.col("m.i") == i) & (F.col("m.j") == j), F.col("m.d"))).cast("string"), F.lit("F")) for i in range(3) for j in range(3)]
    cells[8] = F.lit("2")
    got = m.groupBy("k").agg(F.concat(*cells).alias("relation"))
    return p.each(rows.hint("merge").join(got, "k", "left").select("k", F.when(F.col("fine"), F.coalesce("relation", F.lit("FFFFFFFF2"))).alias("relation"), "dim_a", "dim_b"))


def _at_nodes(noded: Noded, rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """(k, m): at every node, its places in both shapes."""
    n = noded.nodes.hint("merge").join(rows.select("k", "dim_a", "dim_b"), "k")
    bare = noded.bare
    # nodes of an area that its edges leave again on both sides of the same course are no boundary
    rims = bare.select("k", F.explode(F.expr("array(struct(lx as x, ly as y), struct(hx as x, hy as y))")).alias("p"), F.expr("w0 <> 0").alias("rim0"), F.expr("w1 <> 0").alias("rim1")).groupBy("k", "p.x", "p.y").agg(F.bool_or("rim0").alias("rim0"), F.bool_or("rim1").alias("rim1"))
    # ends of open lines: a place where an odd number of them ends is a boundary
    lists = shapes.where(dimension(F.col("g")) == 1).select("k", "side", F.explode(geo.lists(F.col("g"))).alias("r")).where("size(r) > 1 and r[0] <> element_at(r, -1)")
    whole = lambda c: F.round(F.col(c) / noded.grid).cast("long")
    ends = lists.select("k", "side", F.explode(F.expr("array(r[0], element_at(r, -1))")).alias("p")).select("k", "side", whole("p.x").alias("x"), whole("p.y").alias("y"))
    ends = ends.groupBy("k", "x", "y").agg(*[F.expr(f"sum(if(side = {s}, 1, 0)) % 2 = 1").alias(f"end{s}") for s in (0, 1)])
    on = [F.expr(f"bool_or(side = {s} and dim < 2)").alias(f"on{s}") for s in (0, 1)]
    n = n.groupBy("k", "x", "y", "dim_a", "dim_b").agg(*on).hint("merge").join(rims, ["k", "x", "y"], "left").hint("merge").join(ends, ["k", "x", "y"], "left").na.fill(False, ["rim0", "rim1", "end0", "end1"])
    n = saved(n)
    lone = noded.bare.select("k").distinct()
    probes = n.hint("merge").join(lone, "k", "left_semi").where("dim_a = 2 and not rim0 or dim_b = 2 and not rim1").selectExpr("k", "x", "y", "double(x) as mx", "double(y) as my")
    n = n.hint("merge").join(noded.covered(probes, ["x", "y"]), ["k", "x", "y"], "left").na.fill(0, ["c0", "c1"])

    def place(s: int, dim: str) -> str:
        return f"if({dim} = 2, if(rim{s}, 1, if(c{s} <> 0, 0, 2)), if(end{s}, 1, if(on{s}, 0, 2)))"

    return n.selectExpr("k", f"struct({place(0, 'dim_a')} as i, {place(1, 'dim_b')} as j, 0 as d) as m")


def matches(relation: Column, mask: str) -> Column:
    """Whether a matrix fits a mask of T, F, *, 0, 1 and 2."""
    return relation.rlike("^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in mask) + "$")


def _any(r: Column, *masks: str) -> Column:
    out = matches(r, masks[0])
    for m in masks[1:]:
        out = out | matches(r, m)
    return out


def predicate(name: str, r: Column, dim_a: Column, dim_b: Column) -> Column:
    """intersects, disjoint, within, covered_by, touches, crosses, overlaps or equals, of a matrix."""
    masks = {"disjoint": ("FF*FF****",), "within": ("T*F**F***",), "covered_by": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"), "equals": ("T*F**FFF*",)}
    if name == "intersects":
        return ~matches(r, "FF*FF****")
    if name == "touches":
        return ((dim_a > 0) | (dim_b > 0)) & _any(r, "FT*******", "F**T*****", "F***T****")
    if name == "crosses":
        return F.when((dim_a == 1) & (dim_b == 1), matches(r, "0********")).when(dim_a < dim_b, matches(r, "T*T******")).otherwise((dim_a > dim_b) & matches(r, "T*****T**"))
    if name == "overlaps":
        return (dim_a == dim_b) & F.when(dim_a == 1, matches(r, "1*T***T**")).otherwise(matches(r, "T*T***T**"))
    if name not in masks:
        raise ValueError(f"no predicate {name!r}")
    return _any(r, *masks[name])


def simple(shapes: DataFrame, keys: list[str], geometry: str, grid: float = GRID) -> DataFrame:
    """(keys, simple): whether no list of a shape's points meets itself but where it closes; of points,
    whether they differ."""
    rows = saved(shapes.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("k"), F.col(f"`{geometry}`").alias("g")))
    fine = rows.where(F.coalesce(sound(F.col("g"), grid), F.lit(False)))
    lists = fine.where(dimension(F.col("g")) > 0).select("k", F.posexplode(geo.lists(F.col("g"))).alias("n", "r"))
    noded = Noded(lists.select("k", F.lit(0).alias("side"), F.col("n").cast("long").alias("part"), geo.line(F.col("r")).alias("g")), grid)
    run = noded.nodes.where("nx is not null and (x <> nx or y <> ny)")
    ends = run.select("k", "part", F.explode(F.expr("array(struct(x, y), struct(nx as x, ny as y))")).alias("p")).groupBy("k", "part", "p").count().where("count > 2").select("k")
    again = run.groupBy("k", "part", F.expr("least(struct(x, y), struct(nx as x, ny as y))").alias("a"), F.expr("greatest(struct(x, y), struct(nx as x, ny as y))").alias("b")).count().where("count > 1").select("k")
    bad = ends.union(again).distinct().withColumn("bad", F.lit(True))
    spots = F.size(F.array_distinct(geo.points(F.col("g")))) == F.size(geo.points(F.col("g")))
    own = F.when(dimension(F.col("g")) == 0, spots).otherwise(F.col("bad").isNull())
    return rows.hint("merge").join(bad, "k", "left").select("k.*", F.when(F.coalesce(sound(F.col("g"), grid), F.lit(False)), own).alias("simple"))


# buffers


def _rings(r: Column, d: float, other: float, n: int, end: str, join: str, limit: float, areal: Column) -> Column:
    """Closed rings around one list of points whose union is what is within ``d`` on its left and
    ``other`` on its right."""
    plain, wide = join == "round" and other == d, max(d, other)
    size = F.size(r)
    closed = (size > 2) & (F.get(r, F.lit(0)) == F.element_at(r, -1))
    at = lambda i: F.get(r, i)

    def normal(i: Column) -> Column:
        p, q = at(i), at(i + 1)
        h = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        return geo.pt(-(q["y"] - p["y"]) / h, (q["x"] - p["x"]) / h)

    def moved(p: Column, v: Column, k: float | Column) -> Column:
        return geo.pt(p["x"] + v["x"] * k, p["y"] + v["y"] * k)

    def slab(i: Column) -> Column:
        v = normal(i)
        return F.array(moved(at(i), v, -other), moved(at(i + 1), v, -other), moved(at(i + 1), v, d), moved(at(i), v, d), moved(at(i), v, -other))

    def corner(i: Column) -> Column:
        tip = ~closed & ((i == 0) | (i == size - 1))
        round_ = circle(at(i), d if plain else wide, n)
        if plain:
            return F.when(tip & F.lit(end == "flat"), None).otherwise(round_)
        before = F.when(i == 0, size - 2).otherwise(i - 1)
        a, b = normal(before), normal(i)
        turn = a["x"] * b["y"] - a["y"] * b["x"]
        side, far = F.when(turn > 0, -1.0).otherwise(1.0), F.when(turn > 0, other).otherwise(d)
        u, v = moved(at(i), a, side * far), moved(at(i), b, side * far)
        if join == "miter":
            half = F.hypot(a["x"] + b["x"], a["y"] + b["y"]) / 2
            tipped = geo.pt(at(i)["x"] + side * far * (a["x"] + b["x"]) / (2 * half * half), at(i)["y"] + side * far * (a["y"] + b["y"]) / (2 * half * half))
            between = F.when((half > 0) & (1 / half <= limit), F.array(tipped)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        else:
            t0 = F.atan2(side * a["y"], side * a["x"])
            angle = F.pmod(F.atan2(side * b["y"], side * b["x"]) - t0 + math.pi, F.lit(2 * math.pi)) - math.pi
            steps = F.greatest(F.ceil(F.abs(angle) / (2 * math.pi / n)), F.lit(1)).cast("int")
            ks = F.filter(F.sequence(F.lit(1), steps), lambda k: k < steps)
            between = F.transform(ks, lambda k: geo.pt(at(i)["x"] + far * F.cos(t0 + angle * k / steps), at(i)["y"] + far * F.sin(t0 + angle * k / steps)))
        ring = F.concat(F.array(at(i), u), between, F.array(v, at(i)))
        return F.when(tip, F.when(F.lit(end == "flat"), None).otherwise(round_)).when((F.abs(turn) > 1e-9) & (far > 0), ring)

    edges = F.filter(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))), lambda i: i < size - 1)
    tips = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (size > 1) & (~closed | (i < size - 1)))
    return F.concat(F.transform(edges, slab), F.array_compact(F.transform(tips, corner)))


def circle(p: Column, d: float, n: int) -> Column:
    ring = [geo.pt(p["x"] + d * math.cos(2 * math.pi * k / n), p["y"] + d * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return F.array(*ring, ring[0])


def buffer(shapes: DataFrame, keys: list[str], geometry: str, distance: float, points_per_circle: int = 36, end: str = "round", join: str = "round", miter_limit: float = 5.0, point: str = "circle", right: float | None = None, grid: float = GRID, block: int = BLOCK) -> DataFrame:
    """(keys, geometry): what is within ``distance`` of each shape; of an area with a negative distance
    what lies deeper. ``join`` round or miter, ``end`` round or flat, ``point`` circle or square,
    ``right`` another distance for the right of lines. The parts around edges and corners are dissolved."""
    if join not in ("round", "miter") or end not in ("round", "flat") or point not in ("circle", "square"):
        raise ValueError("no such strategy")
    d = abs(distance)
    other = d if right is None else abs(right)
    g = F.col("g")
    rows = saved(shapes.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("k"), F.col(f"`{geometry}`").alias("g")))
    fine = rows.where(F.coalesce(sound(g, grid), F.lit(False)))
    if d == 0 and other == 0:
        return rows.select("k.*", g.alias("geometry"))
    square = lambda p: F.array(*[geo.pt(p["x"] + a * d, p["y"] + b * d) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    spots = F.transform(geo.points(g), lambda p: circle(p, d, points_per_circle) if point == "circle" else square(p))
    around = F.flatten(F.transform(geo.lists(geo.unique(geo.correct(g))), lambda r: _rings(r, d, other, points_per_circle, end, join, miter_limit, geo.is_areal(g))))
    parts = fine.select("k", F.posexplode(F.when(dimension(g) == 0, spots).otherwise(around)).alias("part", "r"))
    inner = distance < 0
    sides = parts.select("k", (F.lit(1) if inner else F.lit(0)).alias("side"), F.col("part").cast("long").alias("part"), geo.polygon(F.col("r")).alias("g"))
    # the area itself is a part of what is around it; a negative distance takes its rim away
    own = fine.where(geo.is_areal(g)).select("k", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("part"), "g")
    rim = sides.hint("merge").join(own.select("k"), "k", "left_anti") if inner else None
    noded = Noded(sides.union(own), grid, merge=True).sided()
    found = areas(_bounds(noded, "difference" if inner else "union").drop("how"), grid, block)
    if inner:  # lines and points have no inside: the distance counts as positive
        alone = areas(_bounds(Noded(rim.withColumn("side", F.lit(0)), grid, merge=True).sided(), "union").drop("how"), grid, block)
        found = found.hint("merge").join(own.select("k"), "k", "left_semi").union(alone)
    out = _parts_of(rows.hint("merge").join(found, "k", "left"))
    return out.select("k.*", F.when(F.coalesce(sound(g, grid), F.lit(False)), F.struct(F.lit("multipolygon").alias("kind"), "parts")).alias("geometry"))
