"""Every query that SQL states is held against DuckDB on the smallest tables."""

import math

import pandas as pd
import pytest

from ledgerloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return round(float(x), 8)
    if type(x).__name__.startswith(("int", "uint")):
        return int(x)
    return bool(x) if type(x).__name__.startswith("bool") else str(x)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    ours = rows_of(catalogue.QUERIES[name](spark, FOLDER).toPandas())
    theirs = rows_of(duck(FOLDER).execute(catalogue.ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
