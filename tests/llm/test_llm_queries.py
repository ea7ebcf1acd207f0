"""Registered queries against their SQL, in DuckDB."""

import duckdb
import pandas as pd
import pytest
from voxframe.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    cell = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    rows = lambda df: sorted((tuple(map(cell, r)) for r in df[columns].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_op8_reads_the_planted_conversation(spark):
    r = queries.op8_chat_format(spark, SF).filter("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, 26)
