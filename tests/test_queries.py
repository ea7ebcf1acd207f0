"""Every registered query runs; those with SQL agree with DuckDB."""

import duckdb
import pandas as pd
import pytest
from voxframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(df: pd.DataFrame) -> list:
    cell = lambda x: None if x is None or x is pd.NA or x != x else float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(cell, row)) for row in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracle_sql():
        want = db.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)
    else:
        assert len(got)
