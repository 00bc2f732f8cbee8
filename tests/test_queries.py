"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}'")
    return con


def plain(df):
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(str, v))
        if pd.isna(v):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 5) + 0.0
        if isinstance(v, (bool, np.bool_, int, np.integer)):
            return round(float(v), 5)
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted((tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    have = plain(catalog.queries()[name](spark, sf_dir).toPandas())
    want = plain(duck.sql(catalog.oracle_sql()[name]).df())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
