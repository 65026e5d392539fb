"""Feed catalog operators: health, buckets, rollups, search and insight rules on catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Minutes without a change up to which a category is healthy, and from which it is risky.
CADENCE_OF = {"intrusion": (1440, 10080), "malware_infrastructure": (1440, 10080), "messaging_abuse": (1440, 20160), "service_abuse": (1440, 20160),
              "anonymizers": (1440, 20160), "scanners": (1440, 20160), "policy_risk": (4320, 43200), "provider_infrastructure": (20160, 129600),
              "special_use": (129600, 525600), "geolocation": (10080, 43200), "asn": (10080, 43200)}
OTHER_CADENCE, GRACE_MINS, ARCHIVAL_MINS = (10080, 43200), 14400, 86400
# End of fixed values.


def thresholds(category: Column, cadence_of: dict[str, tuple[int, int]] = CADENCE_OF, other: tuple[int, int] = OTHER_CADENCE) -> tuple[Column, Column]:
    """Healthy and risky minutes of a category."""
    pick = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for c, v in cadence_of.items() for x in (c, v[i]))), category), F.lit(other[i]))
    return pick(0), pick(1)


def health(feeds: DataFrame, cadence_of: dict[str, tuple[int, int]] = CADENCE_OF, grace_mins: int = GRACE_MINS, archive_mins: int = ARCHIVAL_MINS) -> DataFrame:
    """Adds ``health``; the first rule that holds decides.

    ``feeds`` has category, published, entries, age_excluded, observed, avg_update_mins, idle_mins and
    failing_mins. A feed that fails is unavailable from the age at which it would be unmaintained (with a single
    observation not before its grace ends), and archived once it has been so for ``archive_mins``.
    """
    healthy_mins, risky_mins = thresholds(F.col("category"), cadence_of)
    single = F.col("observed") <= 1
    grace = single & (F.col("idle_mins") > 0) & (F.col("idle_mins") < grace_mins)
    fail_mins = F.when(single, F.greatest(2 * risky_mins, F.lit(grace_mins))).otherwise(2 * risky_mins)
    worst = F.greatest("failing_mins", "idle_mins")
    failing = (F.col("failing_mins") > 0) & (worst >= fail_mins)
    rules = [(~F.col("published"), "unavailable"),
             (failing & (worst - fail_mins >= archive_mins), "archived"),
             (failing, "unavailable"),
             (F.col("entries") == 0, "empty"),
             (F.col("age_excluded") | grace, "healthy"),
             (F.col("idle_mins") >= 2 * risky_mins, "unmaintained"),
             (F.col("idle_mins") >= risky_mins, "risky"),
             (F.col("idle_mins") > F.greatest(F.col("avg_update_mins"), healthy_mins), "delayed")]
    chain: Column | None = None
    for test, name in rules:
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return feeds.withColumn("health", chain.otherwise("healthy"))


# Upper borders in minutes, exclusive, and names of cadence bins.
CADENCES = [(60, "<1h"), (360, "1-6h"), (720, "6-12h"), (1440, "12-24h"), (4320, "1-3d"), (10080, "3-7d"), (40320, "1-4w")]


def cadence(minutes: Column) -> Column:
    chain = F
    for most, name in CADENCES:
        chain = chain.when(minutes < most, name)
    return chain.otherwise(">4w")


def slug(name: Column) -> Column:
    """Lower case, every run of other characters a dash, none at the ends; ``unknown`` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.coalesce(dashed, F.lit("")) == "", "unknown").otherwise(dashed)


def rollup(feeds: DataFrame, key: str) -> DataFrame:
    """Feeds, addresses and distinct maintainers of each value of a key."""
    return feeds.groupBy(key).agg(F.count(F.lit(1)).alias("feeds"), F.sum("unique_ips").alias("ips"), F.count_distinct(F.when(F.col("maintainer") != "", F.col("maintainer"))).alias("maintainers"))


def top_with_other(totals: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n largest values (ties by key) and the sum of the rest as ``other``."""
    top = totals.orderBy(F.desc(value), key).limit(n)
    rest = totals.join(F.broadcast(top.select(key)), key, "left_anti").groupBy().agg(F.sum(value).alias(value)).where(F.col(value).isNotNull())
    return top.select(key, value).unionByName(rest.select(F.lit("other").alias(key), value))


# Least percentages, inclusive, and names of uniqueness buckets.
UNIQUENESS = [(50.0, "very_high"), (20.0, "high"), (5.0, "medium")]
# End of fixed values.


def uniqueness(percent: Column) -> Column:
    """The bucket of a unique share; none is unknown."""
    chain = F
    for least, name in UNIQUENESS:
        chain = chain.when(percent >= least, name)
    return chain.when(percent > 0, "low").otherwise("unknown")


def find(feeds: DataFrame, search: str = "", maintainer: str = "", redistributable: bool | None = None, uniqueness_in: str = "", size_min: int = 0, size_max: int = 0, **equal: str) -> DataFrame:
    """The feeds that meet every given filter, in the order of their names.

    ``search`` is words that all stand somewhere in name, official name, description, maintainer or info, and
    ``maintainer`` a part of that name. ``equal`` names columns (category, provenance, health, freshness,
    cadence, license, critical_tier and so on) and values. Case is ignored; sizes of 0 are no limits. Columns that
    ``search`` could use and the table doesn't have are passed over.
    """
    texts = [c for c in ("feed", "official_name", "short_description", "maintainer", "info") if c in feeds.columns]
    tests = [F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(word)) for word in search.lower().split()]
    if maintainer:
        tests.append(F.contains(F.lower("maintainer"), F.lit(maintainer.lower())))
    if redistributable is not None:
        tests.append(F.col("redistributable") == redistributable)
    if uniqueness_in:
        tests.append(uniqueness(F.col("unique_share_pct")) == uniqueness_in.lower())
    if size_min > 0:
        tests.append(F.col("unique_ips") >= size_min)
    if size_max > 0:
        tests.append(F.col("unique_ips") <= size_max)
    tests += [F.lower(column) == value.lower() for column, value in equal.items() if value]
    for test in tests:
        feeds = feeds.where(test)
    return feeds.orderBy("feed")


def unique_share(pairs: DataFrame, feeds: DataFrame) -> DataFrame:
    """``feed, ips, max_common, samples, percent`` of every feed: the share that no single independent peer has.

    ``pairs`` are rows of iv.compare(), ``feeds`` has feed, unique_ips, maintainer, provenance, hidden, reference
    and leaves (the sources it is made of). A peer is independent if it is shown, no reference table, of a
    primary or secondary upstream, shares no leaf, and is not of the same named maintainer. A feed without
    independent peers has 100 percent.
    """
    both = pairs.select(F.col("name1").alias("feed"), F.col("name2").alias("peer"), "common").unionByName(pairs.select(F.col("name2").alias("feed"), F.col("name1").alias("peer"), "common"))
    who = F.lower(F.trim("maintainer"))
    peers = feeds.select(F.col("feed").alias("peer"), who.alias("peer_who"), F.col("leaves").alias("peer_leaves"),
                         (~F.col("hidden") & ~F.col("reference") & F.col("provenance").isin("primary", "secondary_upstream")).alias("shown"))
    own = feeds.select("feed", F.col("unique_ips").alias("ips"), who.alias("who"), "leaves")
    met = own.join(both, "feed").join(peers, "peer").where("shown and not arrays_overlap(leaves, peer_leaves) and not (peer_who <> '' and peer_who = who)")
    best = own.select("feed", "ips").join(met.groupBy("feed").agg(F.max("common").alias("max_common"), F.count(F.lit(1)).alias("samples")), "feed", "left").fillna(0, ["max_common", "samples"])
    share = (F.when(F.col("ips") == 0, 0.0).when(F.col("samples") == 0, 100.0).when(F.col("max_common") >= F.col("ips"), 0.0)
             .otherwise(100.0 * (F.col("ips") - F.col("max_common")) / F.col("ips")))
    return best.withColumn("percent", F.round(share, 4))


#: Most minutes of a delay; a delay that has grown beyond it grows no more.
RETRY_CAP = 43200


def retry_mins(frequency: Column, failures: Column, unmaintained: Column) -> Column:
    """Delay before another try: the frequency without failures, else a sixteenth of it, doubled for each further failure.

    A maintained feed waits for its frequency at most, which may be above the cap if one doubling leads
    there; what is beyond the cap before it reaches the frequency stays at the cap.
    """
    every, further = F.greatest(frequency, F.lit(1)), F.greatest(failures - 1, F.lit(0))
    after = lambda doublings: F.ceil(every / 16) * F.pow(F.lit(2.0), doublings)
    maintained = F
    for k in range(1, 5):  # a sixteenth doubled four times is the whole
        maintained = maintained.when((further >= k) & (after(F.lit(k - 1)) >= RETRY_CAP), F.lit(float(RETRY_CAP))).when((further >= k) & (after(F.lit(k)) >= every), every)
    grown = F.least(after(F.least(further, F.lit(30))), F.lit(float(RETRY_CAP)))
    return F.when(failures < 1, every).when(unmaintained, grown).otherwise(maintained.otherwise(F.least(grown, every))).cast("long")


def percentile_of(histogram: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """First value whose running weight reaches trunc(total * q), at least 1."""
    w = Window.partitionBy(group)
    run = (histogram.withColumn("_run", F.sum(weight).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .withColumn("_need", F.greatest(F.floor(F.sum(weight).over(w) * q), F.lit(1))))
    return run.where("_run >= _need").groupBy(group).agg(F.min(value).alias("value"))


def top_share(totals: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Adds ``share``, the part of a group's sum, and ``place``, by descending value and then key."""
    w = Window.partitionBy(group)
    return totals.withColumn("share", F.col(value) / F.sum(value).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc(value), key)))


def activity(history: DataFrame, changes: DataFrame, seconds: int, above: int = 100) -> DataFrame:
    """``feed, ts, ips, added, removed, churn``: changes in buckets of some seconds, or one by one for feeds of up to ``above`` changes.

    A change's size is that of the last history row at or before it, else of the first one. Buckets
    count from the first day of year 1.
    """
    first = history.groupBy("feed").agg(F.min_by("unique_ips", "ts").alias("first_ips"))
    every = changes.select("feed", "ts", "added", "removed", F.lit(None).cast("long").alias("unique_ips")).unionByName(
        history.select("feed", "ts", F.lit(None).cast("long").alias("added"), F.lit(None).cast("long").alias("removed"), "unique_ips"))
    w = Window.partitionBy("feed")
    order = w.orderBy("ts", F.col("unique_ips").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = every.withColumn("ips", F.last("unique_ips", True).over(order)).where("added is not null").join(first, "feed").withColumn("ips", F.coalesce("ips", "first_ips"))
    origin = 62135596800
    bucket = F.floor((F.col("ts") + origin) / seconds) * seconds - origin
    placed = sized.withColumn("ts", F.when(F.count(F.lit(1)).over(w) > above, bucket).otherwise(F.col("ts")).cast("long"))
    summed = placed.groupBy("feed", "ts").agg(F.avg("ips").alias("ips"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return summed.withColumn("churn", F.when(F.col("ips") > 0, 100.0 * (F.col("added") + F.col("removed")) / F.col("ips")).otherwise(0.0))


def cadence_floor(history: DataFrame) -> DataFrame:
    """``feed, seconds``: the upper median gap between updates."""
    gap = history.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("feed").orderBy("ts"))).where("gap > 0")
    place = F.row_number().over(Window.partitionBy("feed").orderBy("gap"))
    ranked = gap.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("feed")))
    return ranked.where("place = n div 2 + 1").select("feed", F.col("gap").alias("seconds"))
