"""A cohort ledger that new snapshots update, micro-batch by micro-batch.

The ledger folder holds the cohorts ``feed, lo, hi, added_at`` (what is listed, and since when) as a table of
named versions, of which old ones expire, and for each batch its changes ``feed, ts, added, removed`` and its
removals ``feed, added_at, removed_at, hours, ips``. A batch names its cohorts last, and readers pass over
changes and removals of batches that named none. A batch that runs again starts from the version before it and
writes the same rows over its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rangeloom.operators import intervals as iv
from rangeloom.sources.versions import VersionedTable, written

COHORTS = "feed string, lo long, hi long, added_at long"


REMOVALS = "feed string, added_at long, removed_at long, ips long, hours long"
CHANGES = "feed string, ts long, added long, removed long"


def versions(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, f"{folder}/cohorts", COHORTS)


def cohorts(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The listed ranges with the time since when, as the last finished batch left them."""
    return versions(spark, folder).read(before)


def step(old: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(new cohorts, removals, changes)`` after one snapshot ``feed, ts, lo, hi`` of some feeds; feeds without one stay as they are."""
    times = snapshot.groupBy("feed").agg(F.max("ts").alias("ts"))
    now = iv.optimize(snapshot.select("feed", "lo", "hi"))
    touched = old.join(times, "feed", "left_semi")
    keyed = lambda df: df.select(F.struct("feed", "added_at").alias("feed"), "lo", "hi")
    # Borders of both sides cut each feed into pieces that are in or out as a whole.
    cut = iv.clip(touched.select("feed", "lo", "hi", "added_at").unionByName(now.withColumn("added_at", F.lit(None).cast("long"))))
    ends = F.array(F.struct(F.col("lo").alias("p"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("p"), F.lit(-1).alias("d")))
    borders = cut.select("feed", "bucket", "added_at", F.explode(ends).alias("e"))
    listed, here = F.col("added_at").isNotNull(), F.col("added_at").isNull()
    summed = borders.groupBy("feed", "bucket", "e.p").agg(*(F.sum(F.when(side, F.col("e.d")).otherwise(0)).alias(n) for side, n in ((listed, "was"), (here, "now"))),
                                                         F.sum(F.when(listed, F.col("e.d") * F.col("added_at")).otherwise(0)).alias("since"))
    order = Window.partitionBy("feed", "bucket").orderBy("p")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = summed.select("feed", F.col("p").alias("lo"), (F.lead("p").over(order) - 1).alias("hi"), *(F.sum(c).over(upto).alias(c) for c in ("was", "now", "since"))).where("hi is not null and (was > 0 or now > 0)")
    # A feed's cohorts are disjoint, so the running sum of their times is the time of the one that covers a piece.
    placed = pieces.join(times, "feed")
    stay = placed.where("now > 0").select("feed", "lo", "hi", F.when(F.col("was") > 0, F.col("since")).otherwise(F.col("ts")).alias("added_at"))
    gone = placed.where("now = 0").select("feed", F.col("since").alias("added_at"), F.col("ts").alias("removed_at"), "lo", "hi")
    merged = iv.optimize(keyed(stay)).select("feed.feed", "lo", "hi", "feed.added_at").unionByName(old.join(times, "feed", "left_anti").select("feed", "lo", "hi", "added_at"))
    removals = gone.groupBy("feed", "added_at", "removed_at").agg(F.sum(iv.size()).alias("ips")).withColumn("hours", F.floor((F.col("removed_at") + 1800 - F.col("added_at")) / 3600).cast("long"))
    sized = lambda test: F.sum(F.when(F.expr(test), iv.size()).otherwise(0)).cast("long")
    changes = placed.groupBy("feed", "ts").agg(sized("was = 0").alias("added"), sized("now = 0").alias("removed")).where("added + removed > 0")
    return merged, removals, changes


def apply_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Brings the ledger up to date with a micro-batch; a feed's snapshots in it are taken in the order of their times."""
    spark = batch.sparkSession
    batch = batch.select("feed", "ts", "lo", "hi").persist()
    try:
        ranked = batch.withColumn("k", F.dense_rank().over(Window.partitionBy("feed").orderBy("ts")))
        last = ranked.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
        state = cohorts(spark, folder, batch_id)
        for k in range(1, last + 1):
            new, gone, changed = step(state, ranked.where(F.col("k") == k).drop("k"))
            state = written(new, "ledger-step")
            for name, rows, shape in (("removals", gone, REMOVALS), ("changes", changed, CHANGES)):
                columns = [c.split()[0] for c in shape.split(", ")]
                rows.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}/step={k}")
        versions(spark, folder).replace(state, batch_id)
    finally:
        batch.unpersist()


def start(snapshots: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follows a stream of snapshots ``feed, ts, lo, hi``; a snapshot arrives whole in one micro-batch, as one file does."""
    return (snapshots.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, folder))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _of_named(spark: SparkSession, folder: str, name: str, shape: str) -> DataFrame:
    named = versions(spark, folder).versions()
    if not named:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(f"{shape}, batch long, step long").parquet(f"{folder}/{name}")
    return rows.where(F.col("batch") <= named[-1][0]).drop("batch", "step")


def removals(spark: SparkSession, folder: str) -> DataFrame:
    """``feed, added_at, removed_at, ips, hours`` of everything that has left."""
    return _of_named(spark, folder, "removals", REMOVALS)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """``feed, ts, added, removed`` of every snapshot that changed its feed, the first one included."""
    return _of_named(spark, folder, "changes", CHANGES)
