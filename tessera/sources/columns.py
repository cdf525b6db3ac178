"""Which columns of a table are coordinates, from units in the columns' metadata or from names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.axis import Axis
from tessera.operators.grid import Grid

# The unit names of the climate and forecast conventions.
LATITUDE = frozenset(("degrees_north", "degree_north", "degree_N", "degrees_N", "degreeN", "degreesN"))
LONGITUDE = frozenset(("degrees_east", "degree_east", "degree_E", "degrees_E", "degreeE", "degreesE"))


def role(df: DataFrame, column: str) -> str | None:
    """longitude, latitude, time or None."""
    f = df.schema[column]
    units = (f.metadata or {}).get("units", "")
    if units in LONGITUDE:
        return "longitude"
    if units in LATITUDE:
        return "latitude"
    if f.dataType.typeName().startswith("timestamp") or " since " in units:
        return "time"
    return None


def with_units(df: DataFrame, **units: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"units": units[c]}) if c in units else F.col(c) for c in df.columns])


def grid_from(df: DataFrame, value: str, dims: list[str] | None = None, size: int | None = None, geodetic: bool = False) -> Grid:
    """A grid of a long table: axes from the distinct coordinates; a longitude axis is a circle,
    and time becomes microseconds. Axes come as longitude, latitude, time, others. ``size`` is the
    number of dimensions that there must be; a ``geodetic`` grid must have a longitude and a latitude."""
    dims = dims or [c for c in df.columns if c != value]
    if size is not None and len(dims) != size:
        raise ValueError(f"{len(dims)} dimensions instead of {size}")
    if len(set(dims)) != len(dims) or value in dims:
        raise ValueError("every dimension is another column than the value and the others")
    if geodetic and not {"longitude", "latitude"} <= {role(df, c) for c in dims}:
        raise ValueError("no longitude and latitude among the units of the dimensions")
    order = {"longitude": 0, "latitude": 1, "time": 2, None: 3}
    dims = sorted(dims, key=lambda c: order[role(df, c)])
    roles = {c: role(df, c) for c in dims}
    for c in dims:
        if df.schema[c].dataType.typeName().startswith("timestamp"):
            df = df.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")).cast("double"))
    axes = [Axis.from_column(df, c, 360.0 if roles[c] == "longitude" else None) for c in dims]
    return Grid.from_coordinates(axes, df, dims, value)


def ephemeris(spark, path: str) -> DataFrame:
    """Rows time, lon, lat, height of a text table separated by white space; # begins a comment."""
    t = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    p = F.split(F.trim("value"), r"\s+")
    return t.select(*[F.get(p, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("time", "lon", "lat", "height"))])


def save_state(states: DataFrame, path: str) -> None:
    """State rows (moments, bins, digests' inputs) as Parquet, to be merged later."""
    states.write.mode("overwrite").parquet(path)


def load_state(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
