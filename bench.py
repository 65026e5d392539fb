"""Times the headline queries, first runs and second ones, and prints one JSON line; the value is of the first runs."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rangeloom import catalog

HEADLINE = ("optimize_summary", "compare_all", "asn_counts", "country_counts", "retention_current")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries["bounds"](spark, sf).collect()  # starts the executors
    warm, shuffled, execution = {}, {}, spark.sparkContext._jsc.sc().statusStore()
    written = lambda: execution.executorSummary("driver").totalShuffleWrite()

    def timed(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        before = written()
        took[name] = timed(name)
        shuffled[name] = round((written() - before) / 1e6, 1)
        warm[name] = timed(name)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm": warm, "shuffle_mb": shuffled, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
