"""Bindings over keys whose addresses are the last ones of the space."""

import duckdb

from rangeloom import catalog


def test_ranges_of_lines_at_the_end_of_the_space(spark, tmp_path):
    keys = [7981108, 7981109]  # 4,294,967,284: 99 more is no address
    spark.createDataFrame([(k, 1) for k in keys], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("networks_of_tab_lines", "countries_of_csv_lines"):
        want = con.execute(catalog.oracle_sql()[name]).df()
        got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(tuple(r) for r in got) == sorted(want.itertuples(index=False, name=None))
