"""Totals of countries, networks and maintainers over feeds, as partial states that add up.

``contributions`` has a row for each feed and thing it touches: ``feed, category, kind, key, ips``, with the
kinds ``feed`` (key is the feed), ``country``, ``asn`` and ``maintainer``. A feed has one category, so totals by
category add up to those of any choice of categories, and a feed's change is its new rows less its old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contributions(feeds: DataFrame, countries: DataFrame, networks: DataFrame, slug) -> DataFrame:
    """The rows of ``feeds(feed, category, maintainer, unique_ips)``, ``countries(feed, code, ips)`` and ``networks(feed, asn, ips)``.

    Network 0, which stands for none, and feeds without a maintainer add nothing to those kinds; ``slug`` makes
    a key of a maintainer's name.
    """
    own = feeds.select("feed", F.coalesce("category", F.lit("")).alias("category"), "maintainer", "unique_ips")
    part = lambda df, kind, key, ips: df.select("feed", "category", F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.col(ips).cast("long").alias("ips"))
    named = own.where("trim(coalesce(maintainer, '')) <> ''")
    return (part(own, "feed", F.col("feed"), "unique_ips").unionByName(part(named, "maintainer", slug(F.col("maintainer")), "unique_ips"))
            .unionByName(part(countries.join(own, "feed"), "country", F.col("code"), "ips")).unionByName(part(networks.where("asn <> 0").join(own, "feed"), "asn", F.col("asn"), "ips")))


def partials(rows: DataFrame) -> DataFrame:
    """``category, kind, key, feeds, ips``: written once, they answer for every choice of categories."""
    return rows.groupBy("category", "kind", "key").agg(F.count(F.lit(1)).alias("feeds"), F.sum("ips").alias("ips"))


def totals(parts: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """``kind, key, feeds, ips`` over some categories, by default all."""
    chosen = parts if categories is None else parts.where(F.col("category").isin(list(categories)))
    return chosen.groupBy("kind", "key").agg(F.sum("feeds").alias("feeds"), F.sum("ips").alias("ips"))


def composed(parts: DataFrame, categories: list[str] | None, most: int) -> DataFrame:
    """``kind, place, key, feeds, ips``: the ``most`` largest of each kind but feeds, by feeds, addresses and key.

    The kind ``all`` has one row with the number of feeds and their addresses.
    """
    summed = totals(parts, categories)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("feeds"), F.desc("ips"), "key"))
    top = summed.where("kind <> 'feed'").withColumn("place", place).where(F.col("place") <= most)
    every = summed.where("kind = 'feed'").groupBy().agg(F.coalesce(F.sum("feeds"), F.lit(0)).cast("long").alias("feeds"), F.coalesce(F.sum("ips"), F.lit(0)).cast("long").alias("ips"))
    return top.select("kind", "place", "key", "feeds", "ips").unionByName(every.select(F.lit("all").alias("kind"), F.lit(0).alias("place"), F.lit("").alias("key"), "feeds", "ips"))


def detail(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """The contributions of the feeds that touch one thing, with what each of them has in it as ``within``."""
    touched = rows.where((F.col("kind") == kind) & (F.col("key") == key)).groupBy("feed").agg(F.sum("ips").alias("within"))
    return rows.join(touched, "feed")


def facets(rows: DataFrame, kind: str, key: str, most: int = 10) -> DataFrame:
    """``facet, place, name, feeds, ips``: the largest categories and maintainers of one thing, by addresses in it, feeds and name."""
    own = detail(rows, kind, key)
    categories = own.where("kind = 'feed' and category <> ''").select(F.lit("category").alias("facet"), F.col("category").alias("name"), "within")
    maintainers = own.where("kind = 'maintainer'").select(F.lit("maintainer").alias("facet"), F.col("key").alias("name"), "within")
    summed = categories.unionByName(maintainers).groupBy("facet", "name").agg(F.count(F.lit(1)).alias("feeds"), F.sum("within").alias("ips"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("ips"), F.desc("feeds"), "name"))
    return summed.withColumn("place", place).where(F.col("place") <= most).select("facet", "place", "name", "feeds", "ips")


def refreshed(parts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The partials after some feeds' contributions ``old`` became ``new``; what no feed touches any more goes.

    Only the changed feeds' rows are aggregated; the partials themselves are joined once.
    """
    signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    delta = signed.groupBy("category", "kind", "key").agg(F.sum("sign").cast("long").alias("d_feeds"), F.sum(F.col("sign") * F.col("ips")).alias("d_ips"))
    joined = parts.join(delta, ["category", "kind", "key"], "full")
    added = lambda a, d: (F.coalesce(a, F.lit(0)) + F.coalesce(d, F.lit(0))).cast("long").alias(a)
    return joined.select("category", "kind", "key", added("feeds", "d_feeds"), added("ips", "d_ips")).where("feeds > 0")


def targets(old: DataFrame, new: DataFrame) -> DataFrame:
    """``kind, key`` of every country and network whose page a change of feeds touches: contributions that came, went or differ."""
    before, after = old.select("feed", "category", "kind", "key", F.col("ips").alias("was")), new.select("feed", "category", "kind", "key", F.col("ips").alias("now"))
    joined = before.join(after, ["feed", "category", "kind", "key"], "full").where("kind in ('country', 'asn') and not (was <=> now)")
    return joined.select("kind", "key").distinct()


def findings(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """``category, kind, key, finding``: partials that are missing, extra, or stale beside those that should be there."""
    a, z = stored.select("category", "kind", "key", F.struct("feeds", "ips").alias("has")), expected.select("category", "kind", "key", F.struct("feeds", "ips").alias("wants"))
    finding = F.when(F.col("has").isNull(), "missing").when(F.col("wants").isNull(), "extra").when(F.col("has") != F.col("wants"), "stale")
    return a.join(z, ["category", "kind", "key"], "full").select("category", "kind", "key", finding.alias("finding")).where("finding is not null")
