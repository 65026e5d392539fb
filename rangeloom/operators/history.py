"""Snapshots of feeds over time: changes, cohorts and retention.

A snapshot table has ``feed, ts, lo, hi``; the ranges of one (feed, ts) are disjoint. Ranges are cut
at every border that any snapshot of the feed has, so a piece is in or out of a snapshot as a whole;
every window is then partitioned by (feed, piece) and never holds more rows than there are snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators import intervals as iv


def numbered(snapshots: DataFrame) -> DataFrame:
    """``feed, ts, k, k_last``: snapshot numbers from 1; a row per snapshot."""
    w = Window.partitionBy("feed")
    return (snapshots.select("feed", "ts").distinct()
            .withColumn("k", F.row_number().over(w.orderBy("ts"))).withColumn("k_last", F.max("k").over(w)))


def pieces(snapshots: DataFrame, bits: int = iv.JOIN_BITS) -> DataFrame:
    """The snapshots cut into atomic pieces: ``feed, ts, lo, hi``."""
    return iv.atoms(snapshots.select("feed", "ts", "lo", "hi"), "ts", keys=("feed",), bits=bits).select("feed", F.explode("ts").alias("ts"), "lo", "hi")


def runs(snapshots: DataFrame) -> DataFrame:
    """Unbroken stays: ``feed, lo, hi, added_at, removed_at, last_ts, started``; removed_at is null for those still there."""
    numbers = numbered(snapshots)
    present = pieces(snapshots).join(numbers, ["feed", "ts"])
    order = Window.partitionBy("feed", "lo").orderBy("k")
    stays = (present.withColumn("g", F.col("k") - F.row_number().over(order)).groupBy("feed", "lo", "hi", "g", "k_last")
             .agg(F.min("ts").alias("added_at"), F.max("k").alias("k_end")))
    after = numbers.select("feed", (F.col("k") - 1).alias("k_end"), F.col("ts").alias("removed_at"))
    span = numbers.groupBy("feed").agg(F.min("ts").alias("started"), F.max("ts").alias("last_ts"))
    return (stays.join(after, ["feed", "k_end"], "left").join(span, "feed")
            .select("feed", "lo", "hi", "added_at", "removed_at", "last_ts", "started"))


def changesets(snapshots: DataFrame) -> DataFrame:
    """``feed, ts, added, removed`` where anything changed, the first snapshot included."""
    stays = runs(snapshots)
    added = stays.select("feed", F.col("added_at").alias("ts"), iv.size().alias("added"), F.lit(0).cast("long").alias("removed"))
    removed = stays.where("removed_at is not null").select("feed", F.col("removed_at").alias("ts"), F.lit(0).cast("long").alias("added"), iv.size().alias("removed"))
    return added.unionByName(removed).groupBy("feed", "ts").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def _hours(till: str):
    return F.floor((F.col(till) + 1800 - F.col("added_at")) / 3600).cast("long")


def retention_past(snapshots: DataFrame) -> DataFrame:
    """``feed, hours, ips`` of what was removed, without what the first snapshot brought."""
    gone = runs(snapshots).where("removed_at is not null and added_at > started")
    return gone.groupBy("feed", _hours("removed_at").alias("hours")).agg(F.sum(iv.size()).alias("ips"))


def retention_current(snapshots: DataFrame) -> DataFrame:
    """``feed, hours, ips, incomplete`` of what is listed; 1 where the first snapshot brought some of it."""
    here = runs(snapshots).where("removed_at is null")
    marked = here.groupBy("feed", _hours("last_ts").alias("hours")).agg(F.sum(iv.size()).alias("ips"), F.max((F.col("added_at") <= F.col("started")).cast("int")).alias("first"))
    return marked.withColumn("incomplete", F.max("first").over(Window.partitionBy("feed"))).drop("first")


def first_seen(snapshots: DataFrame) -> DataFrame:
    """``feed, lo, hi, first_seen`` of every listed piece: the start of its present stay."""
    return runs(snapshots).where("removed_at is null").select("feed", "lo", "hi", F.col("added_at").alias("first_seen"))


def sizes(snapshots: DataFrame) -> DataFrame:
    """The history ``feed, ts, entries, unique_ips``."""
    keyed = snapshots.select(F.struct("feed", "ts").alias("feed"), "lo", "hi")
    return iv.summary(iv.optimize(keyed)).select("feed.feed", "feed.ts", "entries", "unique_ips")


def history_stats(history: DataFrame) -> DataFrame:
    """Versions, gaps between updates in seconds and sizes of each feed."""
    gap = history.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("feed").orderBy("ts")))
    return gap.groupBy("feed").agg(F.count(F.lit(1)).alias("versions"), F.sum("gap").alias("gap_total"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"),
                                   F.min("unique_ips").alias("ips_min"), F.max("unique_ips").alias("ips_max"))


def churn(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes after the first, with what stayed: size less removed, where that is not negative."""
    order = Window.partitionBy("feed").orderBy("ts")
    later = changes.where("added + removed > 0").withColumn("n", F.row_number().over(order)).where("n > 1").drop("n")
    return (later.join(history.select("feed", "ts", "unique_ips"), ["feed", "ts"])
            .withColumn("kept", F.when(F.col("removed") <= F.col("unique_ips"), F.col("unique_ips") - F.col("removed")).otherwise(0).cast("long")))


def rotation(churned: DataFrame) -> DataFrame:
    """Median and upper quartile of changes over size, and over kept plus changes."""
    moved = F.col("added") + F.col("removed")
    shares = churned.where("unique_ips > 0").select("feed", (moved / F.col("unique_ips")).alias("x"), (moved / (F.col("kept") + moved)).alias("y"))
    return shares.groupBy("feed").agg(*(F.round(F.percentile(c, F.lit(q)), 2).alias(f"{n}_{int(q * 100)}") for c, n in (("x", "of_size"), ("y", "of_turnover")) for q in (0.5, 0.75)))


def window_union(snapshots: DataFrame, seconds: int) -> DataFrame:
    """The present list of each feed with every snapshot newer than the given span before it."""
    last = snapshots.groupBy("feed").agg(F.max("ts").alias("last_ts"))
    return iv.optimize(snapshots.join(last, "feed").where(F.col("ts") > F.col("last_ts") - seconds).select("feed", "lo", "hi"))
