"""Ledger rows as they are loaded: parsed and checked history, public series, failure streaks, repaired times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of the years 2000 and 2100, the largest number of a JSON date, and how many points are public.
FIRST_SECOND, LAST_SECOND = 946684800, 4102444800
LARGEST_SECOND = 253402300799
PUBLIC_POINTS = 500
# Borders in seconds of how fresh a feed is, inclusive, and their names.
FRESHNESS = [(3600, "hour"), (86400, "day"), (7 * 86400, "week"), (30 * 86400, "month")]
# Intervals that activity can be shown in.
INTERVALS = [("1h", 3600), ("1d", 86400), ("1w", 7 * 86400), ("1mo", 30 * 86400), ("3mo", 90 * 86400), ("1y", 365 * 86400)]
# End of fixed values.


def valid_second(ts: Column) -> Column:
    return (ts >= FIRST_SECOND) & (ts <= LAST_SECOND)


def parsed_history(lines: DataFrame) -> DataFrame:
    """``feed, pos, ts, entries, unique_ips`` of lines ``feed, pos, line``; what isn't three numbers, or out of its years, is passed over."""
    part = F.split("line", ",", -1)
    number = lambda i: F.when(F.trim(F.get(part, F.lit(i))).rlike("^[0-9]{1,18}$"), F.trim(F.get(part, F.lit(i))).try_cast("long"))
    rows = lines.where(F.size(part) == 3).select("feed", "pos", number(0).alias("ts"), number(1).alias("entries"), number(2).alias("unique_ips"))
    return rows.where(valid_second(F.col("ts")) & F.col("entries").isNotNull() & F.col("unique_ips").isNotNull())


def loaded_history(rows: DataFrame) -> DataFrame:
    """The rows ``feed, pos, ts, entries, unique_ips`` that count: of those that don't rise the last one, and then only what rises.

    A row stands unless the next one of its feed is not later; what then isn't later than all before it is dropped.
    """
    order = Window.partitionBy("feed").orderBy("pos")
    after = F.lead("ts").over(order)
    stands = rows.withColumn("after", after).where("after is null or after > ts").drop("after")
    before = F.max("ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return stands.withColumn("before", before).where("before is null or ts > before").drop("before")


def public_history(rows: DataFrame, most: int = PUBLIC_POINTS) -> DataFrame:
    """The last ``most`` rows of each feed by time."""
    place = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("ts")))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def rising(events: DataFrame) -> DataFrame:
    """The events ``feed, ts, ...`` that are later than all of their feed before them, in the order of ``pos``."""
    before = F.max("ts").over(Window.partitionBy("feed").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("before", before).where("before is null or ts > before").drop("before")


def streaks(events: DataFrame) -> DataFrame:
    """``feed, ts, failures, failure_started`` after the last of each feed's ``events(feed, ts, ok, pos)``.

    Failures count from the last success on; without one since, the first failure's time is their start, else
    both are 0. Late events are passed over.
    """
    last_ok = F.max(F.when(F.col("ok"), F.col("ts"))).over(Window.partitionBy("feed"))
    since = rising(events).withColumn("last_ok", last_ok)
    failed = ~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))
    return since.groupBy("feed").agg(F.max("ts").alias("ts"), F.count_if(failed).alias("failures"), F.coalesce(F.min(F.when(failed, F.col("ts"))), F.lit(0).cast("long")).alias("failure_started"))


def repaired(entries: DataFrame) -> DataFrame:
    """Entries whose impossible times (below 0, or beyond the largest) are taken from other evidence.

    ``entries`` has source_date, processed_date, checked_date, started_date, failure_started, and what the
    ledgers say as first_ts and latest_ts. A time that is possible, or 0, stays.
    """
    ok = lambda c: (c > 0) & (c <= LARGEST_SECOND)
    bad = lambda c: (c < 0) | (c > LARGEST_SECOND)

    def put(df: DataFrame, name: str, *evidence: str) -> DataFrame:
        found = F.coalesce(*(F.when(ok(F.col(e)), F.col(e)) for e in evidence), F.lit(0).cast("long"))
        return df.withColumn(name, F.when(bad(F.col(name)), found).otherwise(F.col(name)))

    out = put(entries, "source_date", "latest_ts")
    out = put(out, "processed_date", "latest_ts", "source_date")
    out = put(out, "checked_date", "failure_started", "processed_date", "source_date", "latest_ts")
    out = put(out, "started_date", "first_ts", "source_date", "processed_date")
    return put(out, "failure_started")


def skew(source_date: Column, now: Column) -> Column:
    """Seconds that a source's clock is ahead."""
    return F.greatest(F.lit(0), source_date - now)


def freshness(processed: Column, now: Column) -> Column:
    """How long ago a feed was processed; never is older than all."""
    chain = F.when(F.coalesce(processed, F.lit(0)) == 0, "older")
    for most, name in FRESHNESS:
        chain = chain.when(now - processed <= most, name)
    return chain.otherwise("older")


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """``feed, from_class, to_class`` where ``health`` differs between two tables ``feed, health``; a new feed comes from null.

    A first table without any feed gives no transitions.
    """
    had = before.select("feed", F.col("health").alias("from_class"))
    known = F.broadcast(before.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0"))
    joined = after.select("feed", F.col("health").alias("to_class")).join(had, "feed", "left").join(known, F.lit(True), "left_semi")
    return joined.where("not (from_class <=> to_class)").select("feed", "from_class", "to_class")


def chosen_interval(history: DataFrame, changes: DataFrame, most: int = 100, frequency_mins: int = 0) -> DataFrame:
    """``feed, interval, seconds, rows``: the finest interval that gives at most ``most`` rows and is no finer than the cadence.

    The cadence is the given frequency, or the upper median gap of the history. Rows of all intervals are
    counted in one pass: a row begins where a change is in another bucket than the change before it. If no
    interval will do, the coarsest is taken. Buckets count from the first day of year 1.
    """
    from rangeloom.operators.feeds import cadence_floor

    order = Window.partitionBy("feed").orderBy("ts")
    bucket = lambda ts, seconds: F.floor((ts + 62135596800) / seconds)
    before = F.lag("ts").over(order)
    begun = changes.select("feed", "ts", before.alias("before"))
    counted = begun.groupBy("feed").agg(*(F.count_if(F.col("before").isNull() | (bucket(F.col("ts"), s) != bucket(F.col("before"), s))).alias(name) for name, s in INTERVALS))
    floors = cadence_floor(history).withColumnRenamed("seconds", "floor")
    least = F.lit(frequency_mins * 60) if frequency_mins > 0 else F.coalesce("floor", F.lit(0))
    every = F.array(*(F.struct(F.lit(name).alias("interval"), F.lit(s).cast("long").alias("seconds"), F.col(name).alias("rows")) for name, s in INTERVALS))
    fits = F.filter("every", lambda x: (x["seconds"] >= F.col("least")) & (x["rows"] <= most))
    joined = counted.join(floors, "feed", "left").select("feed", every.alias("every"), least.alias("least"))
    return joined.select("feed", F.coalesce(F.get(fits, F.lit(0)), F.element_at("every", -1)).alias("c")).select("feed", "c.*")
