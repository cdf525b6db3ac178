"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def andoyer_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Andoyer distance in metres between two points, SQL of degrees."""
    lon1, lat1, lon2, lat2 = (f"({x})" for x in (lon1, lat1, lon2, lat2))
    f, g, l = f"radians(({lat1} + {lat2}) / 2)", f"radians(({lat1} - {lat2}) / 2)", f"radians(({lon1} - {lon2}) / 2)"  # noqa: E741
    s = f"(sin({g}) ** 2 * cos({l}) ** 2 + cos({f}) ** 2 * sin({l}) ** 2)"
    c = f"(cos({g}) ** 2 * cos({l}) ** 2 + sin({f}) ** 2 * sin({l}) ** 2)"
    w = f"atan(sqrt({s} / {c}))"
    r = f"(sqrt({s} * {c}) / {w})"
    return f"CASE WHEN {s} = 0 THEN 0 ELSE 2 * {w} * 6378137.0 * (1 + (1 / 298.257223563) * ((3 * {r} - 1) / (2 * {c}) * sin({f}) ** 2 * cos({g}) ** 2 - (3 * {r} + 1) / (2 * {s}) * cos({f}) ** 2 * sin({g}) ** 2)) END"
