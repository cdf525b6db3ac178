"""Weighted moments with mergeable state, quantiles, and binning on axes.

A state row holds n, w (sum of weights), mean, m2..m4 (weighted sums of powers of the distance from
the mean), min, max and sum. Central moments merge without loss of digits, whatever the mean.
Unweighted ones are Spark's own aggregates, in one pass with map-side combine; weighted ones take
the means first and sum around them in a second pass. Samples that are NULL or NaN are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import digest
from .axis import Axis

STATE = ("n", "w", "mean", "m2", "m3", "m4", "min", "max", "sum")
OUTPUT = ("count", "sum_of_weights", "sum", "mean", "min", "max", "variance", "std", "skewness", "kurtosis")


def _real(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _power(d: Column, k: int) -> Column:
    return reduce(lambda a, b: a * b, [d] * k)


def unweighted_state(x: Column) -> list[Column]:
    """Aggregates that make a state row of samples of weight one; they serve streams too."""
    x = _real(x)
    n, v = F.count(x).cast("double"), F.var_pop(x)
    shape = lambda c: F.when(v > 0, F.nanvl(c, F.lit(0.0))).otherwise(0.0 * v)
    return [
        F.count(x).alias("n"),
        F.when(n > 0, n).alias("w"),
        F.avg(x).alias("mean"),
        (n * v).alias("m2"),
        (n * F.pow(v, F.lit(1.5)) * shape(F.skewness(x))).alias("m3"),
        (n * v * v * F.when(v > 0, F.nanvl(F.kurtosis(x), F.lit(-3.0)) + 3).otherwise(0.0 * v)).alias("m4"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sum(x).alias("sum"),
    ]


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """``a`` with the columns of ``b``, a row for each group; null keys are equal."""
    if not by:
        return a.join(F.broadcast(b))  # one row
    b = b.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in b.columns if c not in by])
    return a.join(b, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])).drop(*[f"__{c}" for c in by])


def state(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """State rows (*by, STATE) of the groups of ``by``."""
    by = list(by)
    if weight is None:
        return df.groupBy(*by).agg(*unweighted_state(F.col(value)))
    rows = df.select(*by, _real(F.col(value)).alias("x"), F.col(weight).cast("double").alias("k"))
    rows = rows.withColumn("k", F.when(F.col("x").isNotNull(), F.coalesce("k", F.lit(0.0))))
    means = rows.groupBy(*by).agg((F.sum(F.col("k") * F.col("x")) / F.nullif(F.sum("k"), F.lit(0.0))).alias("mean"))
    d = F.col("x") - F.col("mean")
    sums = [F.sum(F.col("k") * _power(d, j)).alias(f"m{j}") for j in (2, 3, 4)]
    return _same(rows, means, by).groupBy(*by).agg(F.count("x").alias("n"), F.sum("k").alias("w"), F.first("mean").alias("mean"), *sums, F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("k") * F.col("x")).alias("sum"))


def merge(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """State rows of groups from state rows of their parts."""
    by = list(by)
    means = states.groupBy(*by).agg((F.sum(F.col("w") * F.col("mean")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("whole"))
    w, d, m2, m3, m4 = F.col("w"), F.col("mean") - F.col("whole"), F.col("m2"), F.col("m3"), F.col("m4")
    sums = [
        F.sum(m2 + w * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + w * _power(d, 3)).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + w * _power(d, 4)).alias("m4"),
    ]
    return _same(states, means, by).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.first("whole").alias("mean"), *sums, F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))


def finish(ddof: int = 0) -> list[Column]:
    """Statistics from a state row."""
    w = F.col("w")
    m2 = F.col("m2") / w
    variance = F.when(w - ddof > 0, F.col("m2") / (w - ddof))
    # a spread that is rounding alone has no shape
    ok = m2 > 1e-28 * F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-300))
    return [
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        F.coalesce(w, F.lit(0.0)).alias("sum_of_weights"),
        F.coalesce("sum", F.lit(0.0)).alias("sum"),
        F.col("mean"),
        F.col("min"),
        F.col("max"),
        variance.alias("variance"),
        F.sqrt(variance).alias("std"),
        F.when(ok, F.col("m3") / w / F.pow(m2, F.lit(1.5))).alias("skewness"),
        F.when(ok, F.col("m4") / w / (m2 * m2) - 3).alias("kurtosis"),
    ]


def describe(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None, ddof: int = 0) -> DataFrame:
    """Moments of ``value`` over everything, or for each group: the rows of a long-format array
    grouped by the dimensions that are kept."""
    return state(df, value, by, weight).select(*by, *finish(ddof))


def merged(states: DataFrame, by: list[str] = (), ddof: int = 0) -> DataFrame:
    return merge(states, by).select(*by, *finish(ddof))


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = (), accuracy: int | None = 10_000) -> DataFrame:
    """Quantiles by a mergeable sketch of bounded size, right to a rank of 1 / ``accuracy``. With
    ``accuracy`` None exact and linear-interpolated: every distinct value of a group is then held
    in one task, which is for small groups only. Weighted ones: ``weighted_quantiles``, ``digest``."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    x = _real(F.col(value))
    arr = F.array(*[F.lit(float(q)) for q in qs])
    got = F.percentile(x, arr) if accuracy is None else F.percentile_approx(x, arr, accuracy)
    out = df.groupBy(*by).agg(got.alias("qs"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    return out.select(*by, "count", "mean", "min", "max", *[F.get("qs", F.lit(i)).alias(f"q{round(100 * q):02d}") for i, q in enumerate(qs)])


def weighted_quantiles(df: DataFrame, value: str, weight: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """For each q the least value whose cumulated weight reaches q of the whole. Weights of equal
    values are summed before they are ordered, so a task holds distinct values, not rows."""
    from pyspark.sql import Window

    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    per = df.select(*by, _real(F.col(value)).alias("x"), F.col(weight).cast("double").alias("w")).where("x is not null and w > 0").groupBy(*by, "x").agg(F.sum("w").alias("w"))
    win = Window.partitionBy(*by)
    run = per.withColumn("cw", F.sum("w").over(win.orderBy("x"))).withColumn("tw", F.sum("w").over(win))
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("cw") >= F.lit(float(q)) * F.col("tw") - 1e-9, F.col("x"))).alias(f"q{round(100 * q):02d}") for q in qs])


def binning1d(df: DataFrame, x: str, z: str, axis: Axis, weight: str | None = None, limits: tuple[float, float] | None = None, empty: bool = True) -> DataFrame:
    """Moments of z in the bins of ``axis`` nearest to x; x outside ``limits`` is dropped."""
    lo, hi = limits or (axis.min_value(), axis.max_value())
    rows = df.where(F.col(x).between(lo, hi)).select(axis.find_index(F.col(x), True).alias("ix"), F.col(z).alias("z"), *([F.col(weight).alias("w0")] if weight else []))
    out = state(rows.where("ix >= 0"), "z", ["ix"], "w0" if weight else None).where("n > 0")
    if empty:
        out = axis.to_dataframe(df.sparkSession).select(F.col("idx").cast("long").alias("ix")).join(out, "ix", "left")
    return out.select("ix", *finish())


def bin2d_state(df: DataFrame, x: str, y: str, z: str, ax: Axis, ay: Axis, weight: str | None = None, simple: bool = True, geodetic: bool = False, out_of_range: str = "clamp") -> DataFrame:
    """State rows by cell. ``simple`` puts a sample into its nearest cell (beyond the ends into the
    edge cell, or dropped). Otherwise it is spread over its four corners by area: planar, or on the
    sphere of equal area if ``geodetic``; samples that are not bracketed are dropped."""
    z_, w = F.col(z), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if simple:
        clamp = out_of_range == "clamp"
        rows = df.select(ax.find_index(F.col(x), clamp).alias("ix"), ay.find_index(F.col(y), clamp).alias("iy"), z_.alias("z"), w.alias("w0"))
        rows = rows.where("ix >= 0 and iy >= 0")
    else:
        b = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), z_.alias("z"), w.alias("w0"), ax.find_indexes(F.col(x)).alias("bx"), ay.find_indexes(F.col(y)).alias("by")).where("bx is not null and by is not null")
        t = fraction(ax, F.col("x"), F.col("bx"))
        y0, y1 = ay.coordinate(F.col("by.i0")), ay.coordinate(F.col("by.i1"))
        u = (F.sin(F.radians("y")) - F.sin(F.radians(y0))) / (F.sin(F.radians(y1)) - F.sin(F.radians(y0))) if geodetic else fraction(ay, F.col("y"), F.col("by"))
        b = b.withColumn("t", t).withColumn("u", u)
        corner = lambda i, j, w: F.struct(F.col(i).alias("ix"), F.col(j).alias("iy"), w.alias("c"))
        t, u = F.col("t"), F.col("u")
        corners = F.array(corner("bx.i0", "by.i0", (1 - t) * (1 - u)), corner("bx.i0", "by.i1", (1 - t) * u), corner("bx.i1", "by.i0", t * (1 - u)), corner("bx.i1", "by.i1", t * u))
        rows = b.select(F.explode(corners).alias("e"), "z", "w0").where("e.c > 1e-12").select("e.ix", "e.iy", "z", (F.col("w0") * F.col("e.c")).alias("w0"))
    return state(rows, "z", ["ix", "iy"], None if simple and weight is None else "w0").where("n > 0")


def fraction(axis: Axis, c: Column, pair: Column) -> Column:
    """Where c lies between the points of its bracket, 0 to 1; across the seam of a periodic axis
    both ends are taken relative to the lower one."""
    lo, hi = axis.coordinate(pair["i0"]), axis.coordinate(pair["i1"])
    if axis.periodic:
        p = F.lit(float(axis.period))
        if axis.ascending:
            return F.pmod(c - lo, p) / F.pmod(hi - lo, p)
        return F.pmod(lo - c, p) / F.pmod(lo - hi, p)
    return (c - lo) / (hi - lo)


def binning2d(df: DataFrame, x: str, y: str, z: str, ax: Axis, ay: Axis, empty: bool = False, **how) -> DataFrame:
    out = bin2d_state(df, x, y, z, ax, ay, **how)
    if empty:  # the grid of all cells is metadata of the axes
        s = df.sparkSession
        grid = ax.to_dataframe(s).select(F.col("idx").cast("long").alias("ix")).join(ay.to_dataframe(s).select(F.col("idx").cast("long").alias("iy")))
        out = grid.join(out, ["ix", "iy"], "left")
    return out.select("ix", "iy", *finish())


def histogram2d(df: DataFrame, x: str, y: str, z: str, ax: Axis, ay: Axis, qs: list[float], accuracy: int | None = 10_000) -> DataFrame:
    """Quantiles of z by nearest cell, samples outside in the edge cells."""
    return quantiles(_cells(df, x, y, z, ax, ay), "z", qs, ["ix", "iy"], accuracy)


def _cells(df: DataFrame, x: str, y: str, z: str, ax: Axis, ay: Axis, weight: str | None = None) -> DataFrame:
    w = [F.col(weight).cast("double").alias("w0")] if weight else []
    return df.select(ax.find_index(F.col(x), True).alias("ix"), ay.find_index(F.col(y), True).alias("iy"), F.col(z).alias("z"), *w).where("ix >= 0 and iy >= 0")


def histogram2d_state(df: DataFrame, x: str, y: str, z: str, ax: Axis, ay: Axis, weight: str | None = None, compression: int = digest.COMPRESSION) -> DataFrame:
    """Digest rows by nearest cell: ``digest.merge(a.union(b), ["ix", "iy"])`` adds two of them,
    ``digest.quantile_columns`` reads them, ``columns.save_state`` keeps them."""
    return digest.build(_cells(df, x, y, z, ax, ay, weight), "z", ["ix", "iy"], "w0" if weight else None, compression)
