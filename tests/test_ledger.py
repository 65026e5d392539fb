"""The streaming ledger against the batch operators over the same snapshots."""

import random

from rangeloom.operators import history
from rangeloom.streaming import ledger


def test_ledger_equals_the_batch_retention(spark, tmp_path):
    rng = random.Random(2)
    shape = "feed string, ts long, lo long, hi long"
    rows, source = [], tmp_path / "in"
    for k in range(4):
        one = [(f, 1_000_000 + 7200 * k, x, x) for f in ("a", "b") for x in sorted(rng.sample(range(0, 60, 2), 18))]
        rows += one
        spark.createDataFrame(one, shape).coalesce(1).write.mode("append").parquet(str(source))
        if k in (1, 3):
            stream = spark.readStream.schema(shape).parquet(str(source))
            ledger.start(stream, str(tmp_path / "ledger"), str(tmp_path / "check")).awaitTermination(100)
    every = spark.createDataFrame(rows, shape)
    want = history.first_seen(every).select("feed", "lo", "first_seen").collect()
    got = ledger.cohorts(spark, str(tmp_path / "ledger")).collect()
    assert sorted((r["feed"], x, r["added_at"]) for r in got for x in range(r["lo"], r["hi"] + 1)) == sorted(tuple(r) for r in want)
    gone = history.runs(every).where("removed_at is not null").groupBy("feed", "added_at", "removed_at").count().collect()
    left = ledger.removals(spark, str(tmp_path / "ledger")).collect()
    assert sorted((r["feed"], r["added_at"], r["removed_at"], r["ips"]) for r in left) == sorted(tuple(r) for r in gone)
