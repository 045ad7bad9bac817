"""Every query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from realty_spark import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = Q.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
