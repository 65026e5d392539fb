"""The insight rules of ages judge the feeds of the snapshots too, and IPv6 windows see starts, not rows."""

from rangeloom import catalog
from rangeloom.operators import ipv6


def test_feeds_of_the_snapshots_are_judged(spark):
    sf = "/root/testdata/sf0.1"
    events = {r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().collect()}
    for name in ("insight_listed_age", "insight_removed_age"):
        assert events <= {r["feed"] for r in catalog.queries()[name](spark, sf).collect()}


def test_ranges_of_one_start_are_one_row_before_the_window(spark):
    lines = spark.createDataFrame([("f", f"::1 - ::{k:x}") for k in range(1, 300)] + [("f", "::400")], "key string, line string")
    found = ipv6.optimize(ipv6.ranges(lines).cache())
    assert [(int(r["lo"]["l"]), int(r["hi"]["l"])) for r in found.orderBy("lo").collect()] == [(1, 299), (1024, 1024)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window"):]
    assert "Aggregate" in below


def test_rows_of_ipv6_ranges_are_reduced_by_hash(spark):
    """Before the windows no task sorts its rows: the longest range of a start is found with a hash table."""
    lines = spark.createDataFrame([("f", f"fff::{k % 7} - fff::{k % 11 + 7}") for k in range(200)] + [("f", "1fff:ffff:ffff:ffff:ffff:ffff:ffff:fff0/124"), ("f", "2000::/127")], "key string, line string")
    found = ipv6.optimize(ipv6.ranges(lines))
    assert sorted(r["line"] for r in found.select(ipv6.range_text().alias("line")).collect()) == ["1fff:ffff:ffff:ffff:ffff:ffff:ffff:fff0-2000::1", "fff::-fff::17"]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.rindex("Window"):]
    assert "HashAggregate" in below and "SortAggregate" not in below and "Window" in plan
