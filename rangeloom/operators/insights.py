"""Insight rules: ``feed, code, value`` for every feed that a rule holds for.

Each rule is a filter on aggregates of one relation, so a catalog of feeds is judged in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Guards and limits of the rules.
LEAST_LISTED, LEAST_REMOVED, LEAST_UPDATES = 100, 1000, 50
WALL_RATIO, WALL_SHARE = 0.9, 0.5
POLICY_RATIO, BAN_RATIO = 5.0, 10.0
CHURN_HIGH, CHURN_LOW = 0.50, 0.05
TOP_THREE, ONE_COUNTRY, NO_COUNTRY, MANY_COUNTRIES = 0.70, 0.95, 0.05, 50
INDEPENDENT_PEERS, INDEPENDENT_SHARE, SUBSET_SHARE = 5, 0.10, 0.95
CROSS_SHARE, CROSS_FEEDS = 0.30, 3
FEW_INFRA_IPS, FEW_INFRA_SHARE = 10, 0.0001
NO_CATEGORY = "uncategorized"
# End of fixed values.


def ages(histogram: DataFrame, *quantiles: float) -> DataFrame:
    """``feed, total`` and ``p<percent>`` of a histogram ``feed, hours, ips``: the first hours whose running sum reaches trunc(total * q), at least 1."""
    w = Window.partitionBy("feed")
    run = histogram.where("ips > 0").withColumn("run", F.sum("ips").over(w.orderBy("hours"))).withColumn("total", F.sum("ips").over(w))
    need = lambda q: F.col("total") if q >= 1 else F.greatest(F.floor(F.col("total") * q), F.lit(1))
    return run.groupBy("feed", "total").agg(*(F.min(F.when(F.col("run") >= need(q), F.col("hours"))).alias(f"p{round(q * 100)}") for q in quantiles))


def observation(feeds: DataFrame) -> Column:
    """Whole hours from ``tracked_since`` to ``snapshot_ts``."""
    return F.when((F.col("tracked_since") > 0) & (F.col("snapshot_ts") > F.col("tracked_since")), F.floor((F.col("snapshot_ts") - F.col("tracked_since")) / 3600)).otherwise(0)


def _named(rows: DataFrame, code: str, value: Column) -> DataFrame:
    return rows.select("feed", F.lit(code).alias("code"), value.cast("double").alias("value"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def listed_age(feeds: DataFrame, listed: DataFrame) -> DataFrame:
    """The observation wall, and the age of three quarters and of the oldest of the listed addresses where no wall stands."""
    seen = feeds.select("feed", observation(feeds).alias("obs"))
    wall = F.greatest(F.floor(WALL_RATIO * F.col("obs")), F.lit(1))
    at_wall = (listed.join(seen, "feed").groupBy("feed", "obs").agg(F.sum("ips").alias("total"), F.sum(F.when(F.col("hours") >= wall, F.col("ips")).otherwise(0)).alias("at_wall"))
               .withColumn("share", F.when(F.col("obs") > 0, F.col("at_wall") / F.col("total")).otherwise(0.0)).where(F.col("total") >= LEAST_LISTED))
    open_ = at_wall.where(F.col("share") < WALL_SHARE).select("feed").join(ages(listed, 0.75, 1.0), "feed").where("p75 > 0")
    return _all(_named(at_wall.where((F.col("obs") > 0) & (F.col("share") >= WALL_SHARE)), "currently_listed_at_observation_wall", F.col("share")),
                _named(open_, "currently_listed_age_p75", F.col("p75")), _named(open_.where("p75 <> p100"), "currently_listed_age_p100", F.col("p100")))


def removed_age(removed: DataFrame) -> DataFrame:
    """How long removed addresses stayed, several retention policies, and permanent bans."""
    at = ages(removed, 0.5, 0.75, 0.9, 1.0).where(F.col("total") >= LEAST_REMOVED)
    slow, banned = F.col("p90") / F.col("p50"), F.col("p100") / F.col("p90")
    return _all(_named(at.where("p75 > 0"), "removed_age_p75", F.col("p75")),
                _named(at.where("p50 > 0 and p90 > 0").where(slow >= POLICY_RATIO), "multiple_retention_policies", slow),
                _named(at.where("p90 > 0 and p100 > 0").where(banned >= BAN_RATIO), "permanent_bans", banned))


def churn(churned: DataFrame) -> DataFrame:
    """High and low churn by the upper median of (added + removed) / size, of feeds with enough updates."""
    counted = churned.groupBy("feed").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= LEAST_UPDATES)
    ratio = (F.col("added") + F.col("removed")) / F.col("unique_ips")
    ranked = (churned.join(counted, "feed", "left_semi").where("unique_ips > 0").withColumn("ratio", ratio)
              .withColumn("place", F.row_number().over(Window.partitionBy("feed").orderBy("ratio"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("feed"))))
    median = ranked.where("place = n div 2 + 1").select("feed", F.col("ratio").alias("median"))
    return _all(_named(median.where(F.col("median") > CHURN_HIGH), "churn_high", F.col("median")), _named(median.where(F.col("median") < CHURN_LOW), "churn_low", F.col("median")))


def size_variation(history: DataFrame) -> DataFrame:
    """The range of sizes over their upper median, of feeds with enough updates whose size changes."""
    w = Window.partitionBy("feed")
    ranked = history.withColumn("place", F.row_number().over(w.orderBy("unique_ips"))).withColumn("n", F.count(F.lit(1)).over(w))
    ranked = ranked.where(F.col("n") >= LEAST_UPDATES).groupBy("feed").agg(F.min("unique_ips").alias("least"), F.max("unique_ips").alias("most"), F.max(F.when(F.expr("place = n div 2 + 1"), F.col("unique_ips"))).alias("median"))
    return _named(ranked.where("median > 0 and least <> most"), "size_variation", (F.col("most") - F.col("least")) / F.col("median"))


def composition(feeds: DataFrame, bogons: DataFrame, tiers: DataFrame) -> DataFrame:
    """Bogons and critical infrastructure. ``bogons`` has feed, bogon_ips, ``tiers`` has feed, tier, ips with a row ``total``."""
    sized = feeds.select("feed", F.col("unique_ips").alias("n"))
    odd = bogons.join(sized, "feed").where(f"n >= {LEAST_LISTED} and bogon_ips > 0")
    by_tier = tiers.join(sized, "feed").groupBy("feed", "n").agg(*(F.max(F.when(F.col("tier") == t, F.col("ips")).otherwise(0)).alias(t) for t in ("hard", "total")))
    soft = (F.col("n") >= LEAST_LISTED) & ((F.col("total") >= FEW_INFRA_IPS) | (F.col("total") / F.col("n") >= FEW_INFRA_SHARE))
    found = by_tier.where("n > 0 and total > 0").where((F.col("hard") > 0) | soft)
    return _all(_named(odd, "bogon_present", F.col("bogon_ips")), _named(found, "infrastructure_present", F.when(F.col("hard") > 0, F.col("hard")).otherwise(F.col("total"))))


def geography(feeds: DataFrame, countries: DataFrame) -> DataFrame:
    """Concentration, diversity and single countries; shares are of the sum over ``countries(feed, code, ips)``."""
    w = Window.partitionBy("feed")
    shares = (countries.join(feeds.where(f"unique_ips >= {LEAST_LISTED}").select("feed"), "feed").withColumn("share", F.col("ips") / F.sum("ips").over(w))
              .withColumn("place", F.row_number().over(w.orderBy(F.desc("ips"), "code"))))
    facts = shares.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("top"), F.sum(F.when(F.col("place") <= 3, F.col("share"))).alias("top3"))
    return _all(_named(facts.where(f"n >= 3 and top3 > {TOP_THREE} and top <= {ONE_COUNTRY}"), "country_concentrated", F.col("top3")),
                _named(facts.where(f"n >= {MANY_COUNTRIES} and top < {NO_COUNTRY}"), "country_diverse", F.col("n")),
                _named(facts.where(f"top > {ONE_COUNTRY}"), "single_country", F.col("top")))


def overlap_facts(pairs: DataFrame, feeds: DataFrame) -> DataFrame:
    """``feed, other, category, our_share, their_share, older`` of each published pair, as a row of either feed.

    ``pairs`` are rows of iv.compare(); only pairs that share addresses are published. ``feeds`` has feed,
    category and started (0 or null for unknown); the other feed is older if both are known and it started first.
    """
    rows = lambda a, z: pairs.select(F.col(f"name{a}").alias("feed"), F.col(f"name{z}").alias("other"), (F.col("common") / F.col(f"ips{a}")).alias("our_share"), (F.col("common") / F.col(f"ips{z}")).alias("their_share"), "common")
    both = rows(1, 2).unionByName(rows(2, 1)).where("common > 0").drop("common")
    mine, theirs = feeds.select("feed", F.col("started").alias("since")), feeds.select(F.col("feed").alias("other"), "category", F.col("started").alias("theirs"))
    older = F.coalesce((F.col("theirs") > 0) & (F.col("since") > 0) & (F.col("theirs") < F.col("since")), F.lit(False))
    return both.join(mine, "feed", "left").join(theirs, "other", "left").select("feed", "other", "category", "our_share", "their_share", older.alias("older"))


def relations(feeds: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Independence, subsets of older feeds and overlap across categories.

    ``overlaps`` has feed, other, category (of the other), our_share and older (whether the other is). Pairs
    without overlap are not published and don't count; others without a category are a category of their own.
    """
    own = feeds.where(f"unique_ips >= {LEAST_LISTED}").select("feed", F.coalesce("category", F.lit("")).alias("own"))
    met = overlaps.where("our_share > 0").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(NO_CATEGORY))).join(own, "feed")
    widest = met.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.max("our_share").alias("top"))
    inside = met.where(F.col("older") & (F.col("our_share") > SUBSET_SHARE)).groupBy("feed").agg(F.max("our_share").alias("top"))
    across = (met.where("category <> own").groupBy("feed", "category").agg(F.count(F.lit(1)).alias("n"), F.max("our_share").alias("top"))
              .where((F.col("n") >= CROSS_FEEDS) & (F.col("top") > CROSS_SHARE)).groupBy("feed").agg(F.max("top").alias("top")))
    return _all(_named(widest.where((F.col("n") >= INDEPENDENT_PEERS) & (F.col("top") < INDEPENDENT_SHARE)), "independent", 1 - F.col("top")),
                _named(inside, "subset_of", F.col("top")), _named(across, "cross_category_overlap", F.col("top")))
