"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from slotwise.plans import backtests, catalogue, forecasts, plant  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(df: pd.DataFrame, dates: set[str]) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if c in dates:
            df[c] = pd.to_datetime(df[c]).dt.date
        elif str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]")
    text = lambda x: "NULL" if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SF)
    dates = {c for c, kind in made.dtypes if kind == "date"}
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(made.columns) == sorted(want.columns)
    assert plain(made.toPandas(), dates) == plain(want, dates)
