"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import numpy as np
import pytest

from tracelake import registry

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].astype(str)
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = comparable(registry.QUERIES[name](spark, AT).toPandas()), comparable(duck.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=2e-6), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, name):
    """Queries without SQL, as registered: rows, the same again, and no infinite value."""
    out = registry.QUERIES[name](spark, AT)
    numbers = [c for c, kind in out.dtypes if kind in ("double", "float")]
    got = comparable(out.toPandas())
    assert len(got) and not np.isinf(got[numbers].to_numpy(float)).any() and got[numbers].notna().to_numpy().any() >= bool(numbers)
    again = comparable(registry.QUERIES[name](spark, AT).toPandas())
    assert got.astype(str).equals(again.astype(str))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
