"""Streams against the same rows in one batch."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import digest
from tessera.streaming import digests

SCHEMA = "k string, x double, w double"


@pytest.fixture
def rows(spark, tmp_path):
    x = F.col("id")
    d = spark.range(6000).select(
        F.when(x % 3 > 0, F.lit("hot")).when(x % 7 == 0, F.lit(None)).otherwise("cold").alias("k"),
        F.when(x % 11 == 0, F.lit(None)).when(x % 13 == 0, F.lit(float("nan"))).otherwise(F.sin(x) * 100).alias("x"),
        (x % 5 - 1).cast("double").alias("w"),
    )
    path = str(tmp_path / "in")
    d.repartition(5).write.parquet(path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 5
    return path


@pytest.mark.parametrize("by", [["k"], []])
def test_many_batches_equal_one(spark, rows, by):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(rows)
    got = {r["k"] if by else None: r for r in digests.latest(digests.digests(stream, "x", by, "w"), by).collect()}
    one = digest.build(spark.read.schema(SCHEMA).parquet(rows), "x", by, "w")
    want = {r["k"] if by else None: r for r in one.select(*by, *digest.COLUMNS).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r["batches"] == 5 and len(r["means"]) <= digest.COMPRESSION + 2
        assert [r[c] for c in ("count", "min", "max")] == [want[k][c] for c in ("count", "min", "max")]
        assert r["weight"] == pytest.approx(want[k]["weight"]) and sum(r["weights"]) == pytest.approx(r["weight"])
        for q in (0.1, 0.5, 0.9):
            a, b = (digest.estimate(np.array(x["means"]), np.array(x["weights"]), x["min"], x["max"], [q])[0] for x in (r, want[k]))
            assert a == pytest.approx(b, abs=2.0)  # of a range of 200


def test_a_stream_goes_on_where_it_stopped(spark, rows, tmp_path):
    """A query that is started again from its checkpoint has the state of the first run."""
    seen = {}
    keep = lambda df, batch: seen.update({r["k"]: (r["batches"], r["count"]) for r in df.collect()})
    for part in (1, 2):
        spark.read.schema(SCHEMA).parquet(rows).write.mode("append").parquet(str(tmp_path / "live"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "live"))
        q = digests.digests(stream, "x", ["k"]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        one = digest.build(spark.read.schema(SCHEMA).parquet(rows), "x", ["k"]).collect()
        assert seen == {r["k"]: (part, part * r["count"]) for r in one}


def test_keys_of_missing_values_alone(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", None, 1.0), ("a", float("nan"), 1.0), ("b", 1.0, -1.0)], SCHEMA).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    got = digests.latest(digests.digests(stream, "x", ["k"], "w"), ["k"]).orderBy("k").collect()
    assert [(r["k"], r["count"], r["weight"], r["min"], r["means"]) for r in got] == [("a", 0, 0.0, None, []), ("b", 0, 0.0, None, [])]
