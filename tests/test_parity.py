"""Every query with an SQL form gives the rows DuckDB gives."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from tidemark.plans import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or isinstance(v, (float, np.floating)) and np.isnan(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return str(int(v)) if float(v).is_integer() else f"{float(v):.9g}"
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_rows_equal_sql(spark, db, name):
    got, want = REGISTRY[name].run(spark, SF).toPandas(), db.execute(REGISTRY[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_queries_without_sql_give_rows(spark, name):
    assert REGISTRY[name].run(spark, SF).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(REGISTRY) <= set(__spark_entry__.queries())
