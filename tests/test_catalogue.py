"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from siltstream.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def canonical(df: pd.DataFrame) -> list[str]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (pd.Timestamp,)) or hasattr(x, "isoformat"):
            return str(x)[:10]
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return float(x) if isinstance(x, (int, float, np.integer, np.floating)) else x

    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(cell(x) for x in row)) for row in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(tables):
    con = duckdb.connect()
    for name in os.listdir(tables):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{name}'")
    return con


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, db, name):
    got = QUERIES[name](spark, tables).toPandas()
    if name in SQL:
        want = db.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"mission_rounds", "frontier_reach"}))
def test_plans_have_no_product(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_repair_restores_every_text(spark, tables):
    assert QUERIES["repair_text"](spark, tables).filter("NOT restored").count() == 0
