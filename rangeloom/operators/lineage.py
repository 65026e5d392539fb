"""Lineage of derived feeds: a graph ``edges(feed, parent, additive)`` over ``feeds(feed, ...)``.

A merge has an additive edge to each input and another kind to each list it subtracts. The closure
is found by doubling: paths of up to 2, 4, 8 steps, each round one join of distinct pairs, so that a
chain of n feeds takes log2(n) rounds. A round is written to the shared folder and counted; the pairs
reached are bounded by the catalog. Cycles are no obstacle: a pair is kept once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.sources.versions import written


def closure(edges: DataFrame) -> DataFrame:
    """``feed, ancestor`` of every path of one step or more."""
    reach = written(edges.where("feed is not null and parent is not null").select("feed", F.col("parent").alias("ancestor")).distinct(), "lineage")
    pairs = reach.count()
    while True:
        further = reach.select("feed", F.col("ancestor").alias("via")).join(reach.select(F.col("feed").alias("via"), "ancestor"), "via").select("feed", "ancestor")
        wider = written(reach.unionByName(further).distinct(), "lineage")
        now = wider.count()
        if now == pairs:
            return reach
        reach, pairs = wider, now


def cycles(edges: DataFrame) -> DataFrame:
    """``cycle, feed``: the feeds that are their own ancestors; those of one cycle share its least feed as ``cycle``."""
    reach = closure(edges)
    back = reach.select(F.col("feed").alias("ancestor"), F.col("ancestor").alias("feed"))
    return reach.join(back, ["feed", "ancestor"]).groupBy("feed").agg(F.min("ancestor").alias("cycle")).select("cycle", "feed")


def dependents(edges: DataFrame) -> DataFrame:
    """``parent, feeds``: the sorted names of what is derived from a feed directly."""
    return edges.where("parent is not null").groupBy("parent").agg(F.sort_array(F.collect_set("feed")).alias("feeds"))


def leaves(feeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``feed, leaf``: the sources a feed is made of, through additive edges; a feed without such edges is its own.

    Names that are not in the catalog are no leaves. A feed that only leads into a cycle has none.
    """
    known, additive = feeds.select("feed").distinct(), edges.where("additive")
    own = known.join(additive.select("feed").distinct(), "feed", "left_anti").select("feed", F.col("feed").alias("leaf"))
    reached = closure(additive).select("feed", F.col("ancestor").alias("leaf")).join(own.select("leaf"), "leaf").join(known, "feed", "left_semi")
    return own.unionByName(reached.select("feed", "leaf"))


def related(leaf_rows: DataFrame) -> DataFrame:
    """``name1, name2``: the pairs of feeds that have a leaf in common, each once."""
    a, b = leaf_rows.select(F.col("feed").alias("name1"), "leaf"), leaf_rows.select(F.col("feed").alias("name2"), "leaf")
    return a.join(b, "leaf").where("name1 < name2").select("name1", "name2").distinct()


def with_leaves(feeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The feeds with ``leaves``, a sorted list."""
    found = leaves(feeds, edges).groupBy("feed").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    return feeds.join(found, "feed", "left").withColumn("leaves", F.coalesce("leaves", F.array().cast("array<string>")))


def redistributable(feeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``feed, redistributable``: whether a feed, and everything it is made of or subtracts, may be passed on; no flag means yes."""
    barred = feeds.where(~F.coalesce("redistributable", F.lit(True))).select("feed").distinct()
    through = closure(edges).join(barred.withColumnRenamed("feed", "ancestor"), "ancestor", "left_semi").select("feed")
    lost = barred.unionByName(through).distinct().withColumn("_lost", F.lit(True))
    return feeds.select("feed").distinct().join(lost, "feed", "left").select("feed", F.col("_lost").isNull().alias("redistributable"))


def last_changes(feeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``feed, changed``: when what a feed shows last changed at its origin.

    A feed has its ``source_date``, or ``processed_date`` where that is 0. A merge or a retention window
    (``provenance``) has the latest of its parents' changes, if any of them has one. A fixpoint: each round
    passes dates on by one edge, and ends when no date changes; edges inside a cycle pass nothing on.
    """
    base = feeds.select("feed", F.when(F.coalesce("source_date", F.lit(0)) > 0, F.col("source_date")).otherwise(F.coalesce("processed_date", F.lit(0))).cast("long").alias("base"), "provenance")
    inside = cycles(edges)
    a, b = inside.toDF("cycle", "feed"), inside.toDF("cycle", "parent")
    passing = (edges.join(a.join(b, "cycle").select("feed", "parent"), ["feed", "parent"], "left_anti")
               .join(base.where("provenance in ('secondary_merge', 'secondary_retention')").select("feed"), "feed", "left_semi").select("feed", "parent").distinct())
    passing = written(passing, "lineage-edges")
    state = written(base.select("feed", "base", F.col("base").alias("changed")), "lineage-dates")
    while True:
        from_parents = passing.join(state.select(F.col("feed").alias("parent"), F.col("changed").alias("theirs")), "parent").groupBy("feed").agg(F.max("theirs").alias("theirs"))
        after = F.when(F.coalesce("theirs", F.lit(0)) > 0, F.col("theirs")).otherwise(F.col("base"))
        wider = written(state.join(from_parents, "feed", "left").select("feed", "base", after.alias("changed"), (after != F.col("changed")).alias("moved")), "lineage-dates")
        state = wider.drop("moved")
        if wider.where("moved").isEmpty():
            return state.select("feed", "changed")


#: What a retention window with one parent takes over from it.
INHERITED = ("started_date", "source_date", "version", "frequency_mins", "average_update_mins", "min_update_mins", "max_update_mins", "failures", "failure_started", "checked_date", "status")


def effective_entries(feeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The entries as an operator sees them, in the order of their names.

    A retention window with a single parent has its parent's dates, cadence and failures, as far as
    the table has such columns; every feed's ``source_date`` is then its last change, if there is one.
    """
    columns = [c for c in INHERITED if c in feeds.columns]
    single = edges.groupBy("feed").agg(F.max("parent").alias("parent"), F.count_distinct("parent").alias("n")).where("n = 1").select("feed", "parent")
    parents = feeds.select(F.col("feed").alias("parent"), F.struct(*columns).alias("theirs"))
    heirs = feeds.where("provenance = 'secondary_retention'").select("feed").join(single, "feed").join(parents, "parent").select("feed", "theirs")
    joined = feeds.join(heirs, "feed", "left").join(last_changes(feeds, edges), "feed", "left")
    taken = {c: F.when(F.col("theirs").isNotNull(), F.col(f"theirs.{c}")).otherwise(F.col(c)) for c in columns}
    if "source_date" in taken:
        taken["source_date"] = F.when(F.col("changed") > 0, F.col("changed")).otherwise(taken["source_date"])
    return joined.select(*(taken.get(c, F.col(c)).alias(c) for c in feeds.columns)).orderBy("feed")
