"""A feed stays in one task where its rows are folded, whatever join dealt them before."""

import hashlib

from rangeloom.operators import intervals as iv
from rangeloom.sources import binary


def test_feeds_stay_whole_after_a_join_that_becomes_a_broadcast(spark, tmp_path):
    rows = [(f, 10 * i, 10 * i + 3) for f in "abc" for i in range(300)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ranges = iv.optimize(spark.createDataFrame(rows, "feed string, lo long, hi long").repartition(5), bits=8)
        written = binary.write(ranges, str(tmp_path), "m")
        assert "REPARTITION_BY_COL" in written._jdf.queryExecution().executedPlan().toString()  # an exchange of its own
        assert sorted(r["feed"] for r in written.collect()) == ["a", "b", "c"]
        assert sorted(tuple(r) for r in binary.read(spark, str(tmp_path), "m", records=100).collect()) == sorted(rows)
        joined = ranges.join(spark.createDataFrame([("a",), ("b",)], "feed string"), "feed")
        want = hashlib.sha256(b"".join(x.to_bytes(4, "big") for i in range(300) for x in (10 * i, 10 * i + 3))).hexdigest()
        assert sorted(tuple(r) for r in iv.content_hash(joined).collect()) == [("a", want), ("b", want)]
    finally:
        for key in settings:
            spark.conf.unset(key)
