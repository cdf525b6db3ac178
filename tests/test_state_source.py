"""The state source: whole commits, appending, versions, lost and surplus parts."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import state


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_saved_in_parts_equals_the_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    d = spark.range(4000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 > 0, F.sin("id")).alias("x"), F.col("id"))
    for part in range(3):
        state.save(stats.state(d.where(F.col("id") % 3 == part), "x", ["k"]), path, append=part > 0)
    got = state.load(spark, path)
    assert got.count() == 21 and state.manifest(path)["number"] == 3
    a, b = (rows(stats.merged(x, ["k"]).select("k", "count", F.round("mean", 12), F.round("variance", 12), "min", "max")) for x in (got, stats.state(d, "x", ["k"])))
    assert a == b


def test_overwriting_appending_and_empty(spark, tmp_path):
    path = f"file:{tmp_path}/s"
    with pytest.raises(Exception, match="no state was committed"):
        state.load(spark, path).collect()
    state.save(spark.range(10), path)
    state.save(spark.range(3), path)
    assert rows(state.load(spark, path)) == [(0,), (1,), (2,)]
    state.save(spark.range(0), path, append=True)
    assert state.load(spark, path).count() == 3
    with pytest.raises(Exception, match="another schema"):
        state.save(spark.range(2).select(F.col("id").alias("other")), path, append=True)
    assert state.load(spark, path).count() == 3  # a refused commit changes nothing
    state.save(spark.range(0), path)
    assert state.load(spark, path).columns == ["id"] and state.load(spark, path).count() == 0


def test_uncommitted_and_damaged_parts(spark, tmp_path):
    path = str(tmp_path / "s")
    state.save(spark.range(6).repartition(2), path)
    stray = f"{path}/parts/part-stray.parquet"
    pa.parquet.write_table(pa.table({"id": [99]}), stray)  # as a lost task leaves it
    assert rows(state.load(spark, path)) == [(i,) for i in range(6)]
    assert state.tidy(path) >= 1 and not os.path.exists(stray)
    assert rows(state.load(spark, path)) == [(i,) for i in range(6)]
    name = state.manifest(path)["parts"][0][0]
    pa.parquet.write_table(pa.table({"id": pa.array([], pa.int64())}), f"{path}/parts/{name}")
    with pytest.raises(Exception, match="instead of"):
        state.load(spark, path).collect()


def test_other_versions_are_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    state.save(spark.range(1), path)
    at = f"{path}/manifest-000000001.json"
    with open(at) as f:
        text = f.read()
    with open(at, "w") as f:
        f.write(text.replace('"version": 1', '"version": 9'))
    with pytest.raises(Exception, match="version 9"):
        state.load(spark, path).collect()
