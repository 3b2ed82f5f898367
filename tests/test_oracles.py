"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from chronopanel.plans import longitudinal, nuisance, relational, reports

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES, SQL = longitudinal.QUERIES | nuisance.QUERIES | relational.QUERIES | reports.QUERIES, longitudinal.SQL | nuisance.SQL | relational.SQL | reports.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(x):
    if x is None or pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(x, 6) + 0.0 if isinstance(x, float) else int(x) if isinstance(x, (bool, int)) else str(x)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["sim_calibrated_intercept", "crossfit_propensity", "saved_importances", "outcome_metrics"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
