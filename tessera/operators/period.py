"""Closed time intervals [begin, last] of whole ticks, and lists of them as DataFrames.

A period's ``end`` is last + 1 tick. Lists have columns ``begin`` and ``last`` (BIGINT ticks) and
any keys, in ``by``, that tell lists apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans of time that one long list is cut into
SLOTS = 256


def period(begin: Column, end: Column, within: bool = True) -> Column:
    return F.struct(begin.alias("begin"), (end if within else end - 1).alias("last"))


def end(p: Column) -> Column:
    return p["last"] + 1


def duration(p: Column) -> Column:
    return p["last"] + 1 - p["begin"]


def is_null(p: Column) -> Column:
    return p["last"] < p["begin"]


def contains_point(p: Column, t: Column) -> Column:
    return t.between(p["begin"], p["last"])


def contains(p: Column, q: Column) -> Column:
    return (q["begin"] >= p["begin"]) & (q["last"] <= p["last"])


def is_adjacent(p: Column, q: Column) -> Column:
    return (q["begin"] == end(p)) | (p["begin"] == end(q))


def is_before(p: Column, t: Column) -> Column:
    return p["last"] < t


def is_after(p: Column, t: Column) -> Column:
    return p["begin"] > t


def intersects(p: Column, q: Column) -> Column:
    return (p["begin"] <= q["last"]) & (q["begin"] <= p["last"])


def is_close(p: Column, t: Column, tolerance: int) -> Column:
    return (t >= p["begin"] - tolerance) & (t <= p["last"] + tolerance)


def intersection(p: Column, q: Column) -> Column:
    return F.when(intersects(p, q), F.struct(F.greatest(p["begin"], q["begin"]).alias("begin"), F.least(p["last"], q["last"]).alias("last")))


def merge(p: Column, q: Column) -> Column:
    return F.when(intersects(p, q) | is_adjacent(p, q), F.struct(F.least(p["begin"], q["begin"]).alias("begin"), F.greatest(p["last"], q["last"]).alias("last")))


def extend(p: Column, t: Column) -> Column:
    return F.struct(F.least(p["begin"], t).alias("begin"), F.greatest(p["last"], t).alias("last"))


def shift(p: Column, offset) -> Column:
    return F.struct((p["begin"] + offset).alias("begin"), (p["last"] + offset).alias("last"))


# lists
def _slots(df: DataFrame, t: str) -> DataFrame:
    """``df`` with ``__slot``, which of ``SLOTS`` equal spans of time ``t`` lies in."""
    ends = df.agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    width = F.greatest((F.col("__hi") - F.col("__lo") + 1) / SLOTS, F.lit(1.0))
    return df.join(F.broadcast(ends)).withColumn("__slot", F.floor((F.col(t) - F.col("__lo")) / width)).drop("__lo", "__hi")  # one row


def _before(sums: DataFrame, value: Column) -> DataFrame:
    """(__slot, __carry): ``value`` over the slots before each; at most ``SLOTS`` rows."""
    w = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__slot", value.over(w).alias("__carry"))


def _one_list(df: DataFrame, gap: int) -> DataFrame:
    """``islands`` of one list: spans of time are walked side by side, each told the farthest end and
    the number of islands before it."""
    w = Window.partitionBy("__slot").orderBy("begin", "last")
    d = _slots(df.select("begin", "last"), "begin")
    far = _before(d.groupBy("__slot").agg(F.max("last").alias("m")), F.max("m"))
    own = F.greatest(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carry"))
    d = d.join(F.broadcast(far), "__slot").withColumn("far", own).drop("__carry")
    d = d.withColumn("new", F.when(F.col("far").isNull() | (F.col("begin") > F.col("far") + 1 + gap), 1).otherwise(0))
    count = _before(d.groupBy("__slot").agg(F.sum("new").alias("m")), F.sum("m"))
    d = d.join(F.broadcast(count), "__slot").withColumn("island", F.coalesce("__carry", F.lit(0)) + F.sum("new").over(w))
    return d.groupBy("island").agg(F.min("begin").alias("begin"), F.max("last").alias("last"), F.count("*").alias("n")).drop("island")


def islands(df: DataFrame, by: list[str] = (), gap: int = 0) -> DataFrame:
    """Joins periods that overlap, touch, or are at most ``gap`` ticks apart, measured from the
    farthest end so far."""
    if not by:
        return _one_list(df, gap)
    w = Window.partitionBy(*by).orderBy("begin", "last")
    far = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(far.isNull() | (F.col("begin") > far + 1 + gap), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(*by, "island").agg(F.min("begin").alias("begin"), F.max("last").alias("last"), F.count("*").alias("n")).drop("island")


def union(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    return islands(a.select(*by, "begin", "last").unionByName(b.select(*by, "begin", "last")), by)


def is_sorted_and_disjoint(df: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """Per list, whether periods in ``order`` begin after the one before has ended."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("ok", F.coalesce(F.col("begin") > F.lag("last").over(w), F.lit(True))).groupBy(*by).agg(F.bool_and("ok").alias("ok"))


def list_duration(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg((F.max_by("last", "begin") + 1 - F.min("begin")).alias("duration"))


def coverage(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Ticks that some period of the list covers."""
    return islands(df, by).groupBy(*by).agg(F.sum(F.col("last") + 1 - F.col("begin")).alias("covered"))


def slice_list(df: DataFrame, order: list[str], start: int, stop: int | None = None, by: list[str] = ()) -> DataFrame:
    """The periods at places start (included) to stop (not included) of each list in ``order``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    d = df.withColumn("__place", place).where(F.col("__place") >= start)
    return (d if stop is None else d.where(F.col("__place") < stop)).drop("__place")


def close_to_any(points: DataFrame, t: str, periods: DataFrame, tolerance: int, by: list[str] = ()) -> DataFrame:
    """Each point with ``close``: whether it lies in a period of its list, widened by the tolerance."""
    wide = periods.select(*by, (F.col("begin") - tolerance).alias("begin"), (F.col("last") + tolerance).alias("last"))
    return belongs(points, t, wide, by).withColumnRenamed("belongs", "close")


def filter_contained(df: DataFrame, begin: int, last: int) -> DataFrame:
    return df.where((F.col("begin") >= begin) & (F.col("last") <= last))


def filter_min_duration(df: DataFrame, ticks: int) -> DataFrame:
    return df.where(F.col("last") + 1 - F.col("begin") >= ticks)


def find_containing(points: DataFrame, t: str, periods: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each point with the period (p_begin, p_last) that contains it, or nulls. Periods of a list
    must be disjoint: the last that begins at or before the point is the only candidate, so one
    ordered pass over points and periods of a list does it, without a range join."""
    a = points.withColumn("row", F.struct("*")).select(*by, F.col(t).alias("t"), F.lit(1).alias("kind"), "row", F.lit(None).cast("struct<begin:long,last:long>").alias("p"))
    b = periods.select(*by, F.col("begin").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.struct(F.col("begin").cast("long").alias("begin"), F.col("last").cast("long").alias("last")).alias("p"))
    both = a.unionByName(b)
    if by:
        w = Window.partitionBy(*by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumn("at", F.last("p", ignorenulls=True).over(w)).where("kind = 1")
    else:  # one list: spans of time side by side, each told the last period before it
        d = _slots(both, "t")
        w = Window.partitionBy("__slot").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
        last = _before(d.groupBy("__slot").agg(F.max("p").alias("m")), F.max("m"))
        seen = d.join(F.broadcast(last), "__slot").withColumn("at", F.coalesce(F.last("p", ignorenulls=True).over(w), F.col("__carry"))).where("kind = 1")
    hit = F.when(F.col("at.last") >= F.col("t"), F.col("at"))
    return seen.select("row.*", hit["begin"].alias("p_begin"), hit["last"].alias("p_last"))


def belongs(points: DataFrame, t: str, periods: DataFrame, by: list[str] = ()) -> DataFrame:
    return find_containing(points, t, islands(periods, by), by).withColumn("belongs", F.col("p_begin").isNotNull()).drop("p_begin", "p_last")


def crosses(points: DataFrame, t: str, periods: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whether, from the point on, some period holds or follows it and begins at or before the
    list's last point."""
    ends = points.groupBy(*by).agg(F.max(t).alias("t_max"))
    if not by:
        far = periods.join(F.broadcast(ends), F.col("begin") <= F.col("t_max")).agg(F.max("last").alias("far"))
        return points.join(F.broadcast(far)).withColumn("crosses", F.coalesce(F.col("far") >= F.col(t), F.lit(False))).drop("far")
    far = periods.join(ends, list(by)).where("begin <= t_max").groupBy(*by).agg(F.max("last").alias("far"))
    return points.join(far, list(by), "left").withColumn("crosses", F.coalesce(F.col("far") >= F.col(t), F.lit(False))).drop("far")
