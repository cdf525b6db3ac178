"""Binning of streams: moments of time windows and cells that take late rows up to a watermark.

The state of a bin is the mergeable state of ``operators.stats``, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.axis import Axis


def binned(stream: DataFrame, ts: str, x: str, z: str, axis: Axis, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming (or batch) frame of window start, bin and moments of z."""
    rows = stream.withWatermark(ts, late).select(F.col(ts).alias("ts"), axis.find_index(F.col(x), True).alias("ix"), F.col(z).alias("z")).where("ix >= 0")
    agg = rows.groupBy(F.window("ts", every).alias("win"), "ix").agg(*stats.unweighted_state(F.col("z")))
    return agg.select(F.col("win.start").alias("start"), "ix", *stats.finish())


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Intervals of activity of each key: rows no farther apart than ``gap``."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("win"), key).agg(F.count("*").alias("n")).select(key, F.col("win.start").alias("start"), F.col("win.end").alias("end"), "n")
