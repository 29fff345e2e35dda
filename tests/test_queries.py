"""Every engine query with SQL agrees with DuckDB on the smallest tables; the entry point runs."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

import __spark_entry__ as entry  # noqa: E402
from tracelake import queries as engine  # noqa: E402

HEAVY = {"window_features", "finite_check", "target_bucket"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    import numpy as np
    import pandas as pd

    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return repr(float(v)) if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(engine.ORACLE_SQL) - HEAVY))
def test_query_agrees_with_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert rows(got.select(*cols).toPandas()) == rows(duck.execute(engine.ORACLE_SQL[name]).fetchdf()[cols])
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 105
    assert set(entry.oracle_sql()) <= set(entry.queries())
    spark.catalog.clearCache()
