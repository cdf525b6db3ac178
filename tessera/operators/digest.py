"""Weighted quantile digests as state rows that merge.

A digest row holds count, weight, min, max and two arrays: the means and weights of centroids, in
order. Centroids are fine near the ends of the distribution and coarse in its middle: a sample at
share q of the weight belongs to the step floor(c / pi * asin(2 q - 1)), c being the compression, so
a digest has at most c + 2 centroids, whatever it was made from. Partitions make digests of what
they read, batch by batch, and only those are shuffled; digests of a group then merge into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMPRESSION, OPEN_GROUPS = 200, 20_000
SCHEMA = "count long, weight double, min double, max double, means array<double>, weights array<double>"
COLUMNS = ("count", "weight", "min", "max", "means", "weights")


def compress(means: np.ndarray, weights: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of samples or centroids in any order."""
    if not len(means):
        return means, weights
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    if len(means) <= compression:
        return means, weights
    middle = (np.cumsum(weights) - weights / 2) / weights.sum()
    step = np.floor(compression / np.pi * np.arcsin(np.clip(2 * middle - 1, -1, 1)))
    first = np.flatnonzero(np.diff(step, prepend=np.nan) != 0)
    total = np.add.reduceat(weights, first)
    return np.add.reduceat(weights * means, first) / total, total


def estimate(means: np.ndarray, weights: np.ndarray, low: float, high: float, qs: np.ndarray) -> np.ndarray:
    """Quantiles, linear between the middles of centroids; the ends are the extremes."""
    if not len(means):
        return np.full(len(qs), np.nan)
    total = weights.sum()
    at = np.concatenate([[0.0], np.cumsum(weights) - weights / 2, [total]])
    return np.interp(np.asarray(qs) * total, at, np.concatenate([[low], means, [high]]))


def joined(rows: list[tuple], compression: int) -> tuple:
    """One digest row of several (count, weight, min, max, means, weights)."""
    means, weights = compress(np.concatenate([p[4] for p in rows]), np.concatenate([p[5] for p in rows]), compression)
    low, high = [p[2] for p in rows if p[0]], [p[3] for p in rows if p[0]]
    return sum(p[0] for p in rows), float(sum(p[1] for p in rows)), min(low, default=None), max(high, default=None), means, weights


def _frame(groups: dict[tuple, tuple], by: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*k, *v) for k, v in groups.items()], columns=[*by, *COLUMNS])


def _checked(compression: int) -> None:
    if compression < 1:
        raise ValueError("compression must be 1 or more")


def parts(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None, compression: int = COMPRESSION) -> DataFrame:
    """Digest rows (k0, k1, ... for ``by``, SCHEMA) of what each task reads, several for a group. Works
    on streams too, there for each batch."""
    _checked(compression)
    by, names = list(by), [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("x"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    schema = StructType([rows.schema[n] for n in names])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple, tuple] = {}
        for pdf in batches:
            groups = pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]
            for key, g in groups:
                key = tuple(None if k is None or k != k else k for k in (key if isinstance(key, tuple) else (key,)))
                x, w = g["x"].to_numpy(float), g["w"].to_numpy(float)
                ok = ~np.isnan(x) & (w > 0)
                x, w = x[ok], w[ok]
                new = (len(x), w.sum(), *((x.min(), x.max()) if len(x) else (None, None)), *compress(x, w, compression))
                open_[key] = joined([open_[key], new], compression) if key in open_ else new
            if len(open_) > OPEN_GROUPS:  # bounds the memory of a task
                yield _frame(open_, names)
                open_ = {}
        if open_:
            yield _frame(open_, names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return rows.mapInPandas(partial, f"{fields}, {SCHEMA}" if fields else SCHEMA)


def build(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None, compression: int = COMPRESSION) -> DataFrame:
    """Digest rows (*by, SCHEMA) of the groups of ``by``. Samples that are missing, or whose weight is
    missing or not positive, are skipped; a group of such samples alone has an empty digest."""
    by, names = list(by), [f"k{i}" for i in range(len(by))]
    out = merge(parts(df, value, by, weight, compression), names, compression)
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], *COLUMNS)


def merge(states: DataFrame, by: list[str] = (), compression: int = COMPRESSION) -> DataFrame:
    """One digest row for each group of digest rows."""
    _checked(compression)
    by = list(by)
    groups = states.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("weight").alias("weight"), F.min("min").alias("min"), F.max("max").alias("max"), F.flatten(F.collect_list("means")).alias("means"), F.flatten(F.collect_list("weights")).alias("weights"))

    @F.pandas_udf("means array<double>, weights array<double>")
    def shrink(means: pd.Series, weights: pd.Series) -> pd.DataFrame:
        out = [compress(np.asarray(m, float), np.asarray(w, float), compression) for m, w in zip(means, weights, strict=True)]
        return pd.DataFrame({"means": [m for m, _ in out], "weights": [w for _, w in out]})

    got = groups.withColumn("c", shrink("means", "weights"))
    return got.select(*by, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "min", "max", F.col("c.means").alias("means"), F.col("c.weights").alias("weights"))


def quantile_columns(qs: list[float]) -> list[Column]:
    """q10, q50, ... of a digest row; NULL of an empty one."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    wanted = np.array(qs, float)

    @F.pandas_udf("array<double>")
    def read(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([None if not len(m) else estimate(np.asarray(m, float), np.asarray(w, float), a, b, wanted) for m, w, a, b in zip(means, weights, low, high, strict=True)])

    got = read("means", "weights", "min", "max")
    return [F.get(got, F.lit(i)).alias(f"q{round(100 * q):02d}") for i, q in enumerate(qs)]


def mean() -> Column:
    """The mean of a digest row, from its centroids."""
    pairs = F.zip_with("means", "weights", lambda m, w: m * w)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.col("weight"), F.lit(0.0))
