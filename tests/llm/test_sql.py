"""The queries that SQL can express against their SQL on the smallest shared tables."""

import duckdb
import pandas as pd
import pytest

from rangeloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def plain(value):
        return "" if value is None or pd.isna(value) else f"{float(value):.9f}" if not isinstance(value, str) else value

    rows = lambda frame: sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
