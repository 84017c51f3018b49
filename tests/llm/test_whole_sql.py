"""Operators 11 and 12 against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from emberglass.llm import op11_fim, op12_divergence
from tests.test_catalogue import SF, rows_of


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("op", [op11_fim, op12_divergence])
def test_against_duckdb(spark, op):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df, got = op.query(spark, SF), con.execute(op.SQL)
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, got.fetchall())
