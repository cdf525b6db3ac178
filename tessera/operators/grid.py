"""Grids as axes and a table of cells, and interpolation from the 2^N corners around a point.

``Grid.cells`` has one row for each cell: index columns i0, i1, ... and ``value``. Points find their
bracket on every axis by Column arithmetic. The corners of each distinct bracket are gathered
once, and points are joined with them by equality of the indices. Spark picks a broadcast where
the size allows, and a shuffle by cell otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geodesy import haversine_term

from .axis import Axis
from .stats import _real, fraction


@dataclass
class Grid:
    axes: list[Axis]
    cells: DataFrame

    @property
    def keys(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.axes))]

    @classmethod
    def from_cells(cls, axes: list[Axis], cells: DataFrame, columns: list[str], value: str) -> Grid:
        """``columns`` name the index of each axis in ``cells``."""
        return cls(axes, cells.select(*[F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(columns)], _real(F.col(value)).alias("value")))

    @classmethod
    def from_coordinates(cls, axes: list[Axis], df: DataFrame, columns: list[str], value: str) -> Grid:
        """From rows of coordinates; those on no axis point are dropped, of equal cells the mean counts."""
        ids = [a.find_index(F.col(c)).alias(f"i{k}") for k, (a, c) in enumerate(zip(axes, columns, strict=True))]
        rows = df.select(*ids, _real(F.col(value)).alias("value"))
        keys = [f"i{k}" for k in range(len(axes))]
        for k in keys:
            rows = rows.where(F.col(k) >= 0)
        return cls(axes, rows.groupBy(*keys).agg(F.avg("value").alias("value")))

    @classmethod
    def from_arrays(cls, axes: list[Axis], df: DataFrame, array: str) -> Grid:
        """From one row that holds the nested array [x][y]...; its sizes must be the axes'."""
        cols, col = [], F.col(array)
        rows = df.select(col.alias("a"))
        for k, a in enumerate(axes):
            rows = rows.select(*cols, F.assert_true(F.size("a") == len(a), "array and axis differ in size").alias("ok"), "a").drop("ok")
            rows = rows.select(*cols, F.posexplode("a").alias(f"i{k}", "a"))
            cols.append(f"i{k}")
        return cls(axes, rows.select(*[F.col(c).cast("long").alias(c) for c in cols], _real(F.col("a")).alias("value")))

    def value(self, df: DataFrame, columns: list[str], out: str = "value") -> DataFrame:
        """Each row with the value of the cell whose indices it holds."""
        right = self.cells.select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col("value").alias(out))
        on = [F.col(c) == F.col(f"__{k}") for c, k in zip(columns, self.keys, strict=True)]
        return df.join(right, on, "left").drop(*[f"__{k}" for k in self.keys])

    def nearest(self, points: DataFrame, columns: list[str], bounded: bool = False, out: str = "value") -> DataFrame:
        """Each point with the value of its nearest cell."""
        names = [f"__n{k}" for k in range(len(columns))]
        p = points.withColumns({n: a.find_index(F.col(c), bounded) for n, a, c in zip(names, self.axes, columns, strict=True)})
        return self.value(p, names, out).drop(*names)


def _checked(value: Column, inside: Column, bounds_error: bool) -> Column:
    if not bounds_error:
        return value
    return F.when(inside, value).otherwise(F.raise_error(F.lit("a point lies outside the grid")).cast("double"))


def bracketed(axes: list[Axis], points: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """id, x0.., k0.. (lower index of the bracket on each axis; all NULL if one is missing) and
    t0.. (where the point lies in it, 0 to 1). Brackets and fractions are made once for each row:
    a generator's output is not inlined into what uses it."""
    n = range(len(axes))
    p = points.select(F.col(id_).alias("id"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in zip(n, columns, strict=True)])
    p = p.select("*", F.explode(F.array(F.struct(*[a.find_indexes(F.col(f"x{k}")).alias(f"b{k}") for k, a in enumerate(axes)]))).alias("b"))
    inside = reduce(lambda a, b: a & b, [F.col(f"b.b{k}").isNotNull() for k in n])
    t = [fraction(a, F.col(f"x{k}"), F.col(f"b.b{k}")).alias(f"t{k}") for k, a in enumerate(axes)]
    lower = [F.when(inside, F.col(f"b.b{k}.i0")).alias(f"k{k}") for k in n]
    p = p.select("id", *[f"x{k}" for k in n], F.explode(F.array(F.struct(*lower, *t))).alias("b"))
    return p.select("id", *[f"x{k}" for k in n], "b.*")


def interpolate(grid: Grid, points: DataFrame, id_: str, columns: list[str], method: str = "bilinear", exponent: float = 2.0, outer: str | list[str] = "linear", bounds_error: bool = False) -> DataFrame:
    """(id, value) of each point. ``method`` works on the first two axes: bilinear, idw (inverse
    distance on the sphere) or nearest; ``outer`` on the others: linear or nearest. NULL outside
    and where a corner has no value.

    The corners of each distinct bracket cell are gathered once into an array, in the order of
    their bits; points are joined with it by the cell, and the rest is arithmetic in the row."""
    n = len(grid.axes)
    if method not in ("bilinear", "idw", "nearest"):
        raise ValueError(f"no method {method!r}")
    outer = [outer] * (n - 2) if isinstance(outer, str) else outer
    names = [f"k{k}" for k in range(n)]
    p = bracketed(grid.axes, points, id_, columns)
    every = list(product((0, 1), repeat=n))
    up = lambda k, b: F.pmod(F.col(f"k{k}") + b, F.lit(len(grid.axes[k]))) if b else F.col(f"k{k}")
    corners = F.array(*[F.struct(*[up(k, b).alias(f"i{k}") for k, b in enumerate(bits)]) for bits in every])
    cells = p.where(F.col("k0").isNotNull()).select(*names).distinct().select(*names, F.posexplode(corners).alias("c", "e")).select(*names, "c", "e.*")
    got = cells.join(grid.cells, grid.keys, "left").groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("z"))  # 2 ** n values
    got = got.where(F.forall("z", lambda e: e["value"].isNotNull())).select(*names, F.transform("z", lambda e: e["value"]).alias("z"))
    p = p.join(got, names, "left")
    planes = 1 << (n - 2)
    value = lambda i, j, o: F.get("z", F.lit((2 * i + j) * planes + o))
    if method == "bilinear":
        side = lambda k, b: F.col(f"t{k}") if b else 1 - F.col(f"t{k}")
        flat = [reduce(lambda a, b: a + b, [side(0, i) * side(1, j) * value(i, j, o) for i in (0, 1) for j in (0, 1)]) for o in range(planes)]
    else:
        x, y = grid.axes[0].coordinate, grid.axes[1].coordinate
        d = [haversine_term(F.col("x0"), F.col("x1"), x(up(0, i)), y(up(1, j))).alias(f"d{i}{j}") for i in (0, 1) for j in (0, 1)]
        p = p.select("*", F.explode(F.array(F.struct(*d))).alias("d"))
        corner = [(i, j, F.col(f"d.d{i}{j}")) for i in (0, 1) for j in (0, 1)]
        if method == "nearest":  # of equal distances the first corner
            least = F.least(*[c[2] for c in corner])
            flat = [F.coalesce(*[F.when(c <= least, value(i, j, o)) for i, j, c in corner]) for o in range(planes)]
        else:
            near = lambda c: c <= 1e-24
            inverse = [(i, j, 1 / F.pow(c, F.lit(exponent / 2))) for i, j, c in corner]
            total = reduce(lambda a, b: a + b, [w for *_, w in inverse])
            flat = [F.coalesce(*[F.when(near(c), value(i, j, o)) for i, j, c in corner], reduce(lambda a, b: a + b, [w * value(i, j, o) for i, j, w in inverse]) / total) for o in range(planes)]
    for k in range(n - 1, 1, -1):  # the last axis is the fastest of the planes
        t = F.col(f"t{k}") if outer[k - 2] == "linear" else F.when(F.col(f"t{k}") >= 0.5, 1.0).otherwise(0.0)
        flat = [a * (1 - t) + b * t for a, b in zip(flat[::2], flat[1::2], strict=True)]
    return p.select(F.col("id").alias(id_), _checked(F.when(F.col("z").isNotNull(), flat[0]), F.col("k0").isNotNull(), bounds_error).alias("value"))
