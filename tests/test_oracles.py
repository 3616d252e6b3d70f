"""Every query of the library with an SQL form gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tallyforge.plans.project import ORACLES, QUERIES
from tallyforge.plans.derive import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "~"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if any(k in type(v).__name__.lower() for k in ("int", "float", "decimal")):
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
