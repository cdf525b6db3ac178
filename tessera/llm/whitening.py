"""Whitening of embeddings: count, mean and centred scatter of each partition, merged pairwise.

A vector counts with whole numbers, ``floor(scale * c) + offset`` of its entries. A partition gives
its count, exact sums, local mean and scatter about that mean; Chan's formula merges two of these,
in a tree of tasks. The driver gets one merged state (``d`` squared numbers for ``d`` dimensions)
and takes its eigenvectors; a second pass over the table measures how far the covariance of the
whitened vectors is from the identity.

Defined cases: a null vector, one with null or non-finite entries, an empty one, and one with an
entry of 2 ** 52 or more in scaled size (no exact whole number) is left out, and so are vectors
whose length is not the most frequent one (the smaller at a tie). Components without variance are
not given; so one vector, or equal ones, give no rows, as an empty table does. Null and repeated
ids are kept, each row for itself; other columns are not read. ``deviation`` is exact at any size,
as a decimal; null beyond 38 digits.
"""

from __future__ import annotations

import decimal
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block inside a task
BLOCK = 4096
#: Scaled entries below this are exact whole numbers as doubles
LARGEST = float(1 << 52)


@dataclass
class Moments:
    """n vectors: exact sums (Python integers), mean, and scatter about the mean."""

    n: int
    total: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        total = x.sum(0).tolist() if np.abs(x).max(initial=0) * len(x) < 2**62 else x.astype(object).sum(0).tolist()
        mean = np.array([t / len(x) for t in total])
        centred = x - mean
        return cls(len(x), total, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        total = [a + b for a, b in zip(self.total, other.total, strict=True)]
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n))
        return Moments(n, total, np.array([t / n for t in total]), scatter)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    if a is None or b is None:
        return b if a is None else a
    return a.merged(b)


@dataclass
class Whitening:
    """``directions``: (dimensions, components); ``identity_error`` is None until it is measured."""

    n: int
    total: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    scale: float
    offset: int
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.total)

    def whole(self, v: np.ndarray) -> np.ndarray:
        return np.floor(v * self.scale).astype(np.int64) + self.offset

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n * x - total, exactly; whether sums of its squares fit into 64 bits. Sums are taken apart
        as n * base + rest, so that numbers stay small."""
        base = np.array([t // self.n for t in self.total], np.int64)
        rest = np.array([t % self.n for t in self.total], np.int64)
        near = x - base
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most < 2**62:
            return near * self.n - rest, most * most * self.width < 2**63
        return near.astype(object) * self.n - rest.astype(object), False

    def project(self, gap: np.ndarray) -> np.ndarray:
        return (gap / self.n).astype(np.float64) @ self.directions / np.sqrt(self.variances)


def _vectors(batch: pa.RecordBatch, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch that count, and their vectors."""
    col = batch.column("v")
    rows = np.flatnonzero((col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width) & col.is_valid().to_numpy(zero_copy_only=False))
    flat = col.take(pa.array(rows)).flatten()
    v = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    fine = (np.abs(v * scale) < LARGEST).all(1)
    return rows[fine], v[fine]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: float):
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            rows, v = _vectors(part, width, scale)
            if len(rows):
                yield part, rows, v


def _read(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v"))


def _merged_over(df: DataFrame, prepare) -> Moments | None:
    """Moments of ``prepare(batch iterator)``'s blocks over all partitions."""

    def partial(batches):
        state = None
        for x in prepare(batches):
            state = merged(state, Moments.of(x))
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(state)], pa.binary())})

    states = df.mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return states.treeReduce(merged) if states.getNumPartitions() else None


def fit(df: DataFrame, vector: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> Whitening | None:
    """None if no vector counts. Two passes: moments, then the check of the identity."""
    sizes = df.groupBy(F.size(F.col(f"`{vector}`")).alias("d")).count().where("d > 0")
    first = sizes.orderBy(F.desc("count"), "d").limit(1).collect()
    if not first:
        return None
    width, read = first[0].d, df.select(F.col(f"`{vector}`").alias("v"))
    blank = Whitening(0, [0] * width, np.zeros((width, 0)), np.zeros(0), np.zeros(0), scale, offset)
    found = _merged_over(read, lambda batches: (blank.whole(v) for _, _, v in _blocks(batches, width, scale)))
    if found is None:
        return None
    covariance = found.scatter / found.n
    value, direction = np.linalg.eigh((covariance + covariance.T) / 2)
    value, direction = value[::-1], direction[:, ::-1]
    some = int((value > max(value[0], 0) * width * np.finfo(float).eps).sum())
    k = min(components, some)
    model = Whitening(found.n, found.total, direction[:, :k], value[:k], value[:k] / np.trace(covariance) if k else value[:0], scale, offset)
    if k:
        seen = _merged_over(read, lambda batches: (model.project(model.centred(model.whole(v))[0]) for _, _, v in _blocks(batches, width, scale)))
        model.identity_error = float(np.abs(seen.scatter / seen.n - np.eye(k)).max())
    return model


def _decimals(gap: np.ndarray, small: bool) -> pa.Array:
    if small:
        return pa.array((gap * gap).sum(1)).cast(pa.decimal128(38, 0))
    sums = (gap.astype(object) ** 2).sum(1).tolist()
    return pa.array([decimal.Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened): a row for each vector that counts, its components in one array."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None or not len(model.variances):
        out = df.sparkSession.createDataFrame([], schema)
    else:
        sent = df.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            m = sent.value
            for part, rows, v in _blocks(batches, m.width, m.scale):
                gap, small = m.centred(m.whole(v))
                white = m.project(gap)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(rows)), _decimals(gap, small), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["k", "deviation", "whitened"])

        out = _read(df, key, vector).mapInArrow(run, schema)
    return out.withColumnRenamed("k", key)
