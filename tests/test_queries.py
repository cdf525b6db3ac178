"""Every registered query against its SQL twin."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(df: pd.DataFrame) -> list:
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert (u is None and v is None) or u == v or str(u) == str(v) or u == pytest.approx(v, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
