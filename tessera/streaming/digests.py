"""Quantile digests as the state of a stream.

Each batch makes digests of what its tasks read, so that a busy key sends a row for a task, not its
samples. The state of a key is one digest, of at most compression + 2 centroids for as many samples
as there ever are; the state store keeps it between batches and through restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import digest
from tessera.session import scratch_path


def digests(stream: DataFrame, value: str, by: list[str] = (), weight: str | None = None, compression: int = digest.COMPRESSION) -> DataFrame:
    """Streaming frame (*by, batches, and the columns of a digest): after each batch the digests of
    all samples so far, for the keys that the batch touched (output mode update). ``batches`` counts
    the batches that a key was in. Samples that are missing, or whose weight is missing or not
    positive, are skipped. Without ``by`` there is one digest. A key's state stays as long as the
    stream: put a bounded set of keys, such as days of a retention, into ``by``."""
    by, names = list(by), [f"k{i}" for i in range(len(by))]
    parts = digest.parts(stream, value, by, weight, compression)
    if not by:
        names, parts = ["k0"], parts.select(F.lit(0).alias("k0"), *digest.COLUMNS)
    keys = ", ".join(f"{n} {parts.schema[n].dataType.simpleString()}" for n in names)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batches, *old = state.get if state.exists else (0,)
        rows = [_row(*old)] if old else []
        for pdf in frames:
            rows += [_row(*r) for r in pdf[list(digest.COLUMNS)].itertuples(index=False)]
            rows = [digest.joined(rows, compression)]  # one digest at a time, however many tasks sent one
        n, w, low, high, means, weights = rows[0]
        new = (int(n), float(w), low, high, means.tolist(), weights.tolist())
        state.update((batches + 1, *new))
        yield pd.DataFrame([(*key, batches + 1, *new)], columns=[*names, "batches", *digest.COLUMNS])

    out = parts.groupBy(*names).applyInPandasWithState(update, f"{keys}, batches long, {digest.SCHEMA}", f"batches long, {digest.SCHEMA}", "update", GroupStateTimeout.NoTimeout)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "batches", *digest.COLUMNS)


def _row(n, w, low, high, means, weights) -> tuple:
    missing = not n
    return int(n), float(w), None if missing else float(low), None if missing else float(high), np.asarray(means, float), np.asarray(weights, float)


def latest(stream: DataFrame, by: list[str] = ()) -> DataFrame:
    """What ``digests`` says once all that is there has been read: the last row of each key. Every
    batch is written under its number, so one that is repeated after a failure replaces itself."""
    spark, root = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{root}/out")
    last = F.max_by(F.struct("batches", *digest.COLUMNS), "batch").alias("d")
    return rows.groupBy(*by).agg(last).select(*by, "d.*")
