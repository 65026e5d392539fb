"""Attribution of feeds to reference networks: interval joins and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators import intervals as iv

# Reserved IPv4 blocks as first address, prefix and name.
RESERVED = [("0.0.0.0", 8, "Current network"), ("10.0.0.0", 8, "RFC 1918 private (10/8)"), ("100.64.0.0", 10, "Carrier-grade NAT"), ("127.0.0.0", 8, "Loopback"),
            ("169.254.0.0", 16, "Link-local"), ("172.16.0.0", 12, "RFC 1918 private (172.16/12)"), ("192.0.0.0", 24, "IETF protocol assignments"),
            ("192.0.2.0", 24, "TEST-NET-1"), ("192.88.99.0", 24, "6to4 relay anycast (deprecated)"), ("192.168.0.0", 16, "RFC 1918 private (192.168/16)"),
            ("198.18.0.0", 15, "Network benchmarking"), ("198.51.100.0", 24, "TEST-NET-2"), ("203.0.113.0", 24, "TEST-NET-3"),
            ("224.0.0.0", 4, "IPv4 multicast"), ("240.0.0.0", 4, "Reserved for future use")]
# End of fixed values.


def reserved_rows() -> list[tuple[str, int, int]]:
    """(name, lo, hi) of the reserved blocks."""
    number = lambda text: sum(int(x) << s for x, s in zip(text.split("."), (24, 16, 8, 0), strict=True))
    return [(name, number(ip), number(ip) + (1 << 32 - prefix) - 1) for ip, prefix, name in RESERVED]


def counts(optimized: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """Addresses of each feed in each group of reference ranges; an address in several ranges of a group counts once."""
    met = iv.cover(feed=optimized.select("feed", "lo", "hi"), key=reference.select("lo", "hi", *keys)).where("size(feed) > 0 and size(key) > 0")
    pairs = met.select("ips", F.explode("feed").alias("feed"), "key").select("ips", "feed", F.explode("key").alias("key"))
    named = pairs.groupBy("feed", "key").agg(F.sum("ips").alias("ips"))
    return named.select("feed", *(F.col(f"key.{k}" if len(keys) > 1 else "key").alias(k) for k in keys), "ips")


def covered(optimized: DataFrame, reference: DataFrame, name: str = "ips") -> DataFrame:
    """Addresses of each feed in any reference range, each counted once."""
    met = iv.cover(feed=optimized.select("feed", "lo", "hi"), key=reference.select("lo", "hi", F.lit(True).alias("any"))).where("size(feed) > 0 and size(key) > 0")
    return met.select("ips", F.explode("feed").alias("feed")).groupBy("feed").agg(F.sum("ips").alias(name))


def network_shares(optimized: DataFrame, networks: DataFrame) -> DataFrame:
    """``feed, asn, ips, percent``: what no network holds is asn 0; percents are of the feed's addresses.

    One sweep gives the counts and, as a row without a number, the feed's addresses in all.
    """
    met = iv.cover(feed=optimized.select("feed", "lo", "hi"), asn=networks.select("lo", "hi", F.col("asn").cast("long").alias("asn"))).where("size(feed) > 0")
    each = F.concat(F.when(F.size("asn") > 0, F.col("asn")).otherwise(F.array(F.lit(0).cast("long"))), F.array(F.lit(None).cast("long")))
    counted = met.select("ips", F.explode("feed").alias("feed"), each.alias("asn")).select("ips", "feed", F.explode("asn").alias("asn")).groupBy("feed", "asn").agg(F.sum("ips").alias("ips"))
    whole = F.max(F.when(F.col("asn").isNull(), F.col("ips"))).over(Window.partitionBy("feed"))
    return counted.withColumn("whole", whole).where("asn is not null").select("feed", "asn", "ips", F.round(F.col("ips") * 100.0 / F.col("whole"), 4).alias("percent"))


def joint(optimized: DataFrame, first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Counts by two attributions at once; each key is a column of one of them."""
    of = lambda table: [k for k in keys if k in table.columns]
    met = iv.cover(feed=optimized.select("feed", "lo", "hi"), first=first.select("lo", "hi", F.struct(*of(first)).alias("f")), second=second.select("lo", "hi", F.struct(*of(second)).alias("s")))
    for x in ("feed", "first", "second"):
        met = met.where(F.size(x) > 0).withColumn(x, F.explode(x))
    return met.groupBy("feed", *(F.col(f"first.{k}").alias(k) for k in of(first)), *(F.col(f"second.{k}").alias(k) for k in of(second))).agg(F.sum("ips").alias("ips"))


def tiers(optimized: DataFrame, critical: DataFrame) -> DataFrame:
    """``feed, tier, ips, providers``: unique addresses of each tier, and of all tiers under ``total``.

    Providers may overlap; a tier's addresses are those of the union of its providers' ranges.
    """
    met = iv.cover(feed=optimized.select("feed", "lo", "hi"), by=critical.select("lo", "hi", "tier", "provider")).where("size(feed) > 0 and size(by) > 0")
    every = F.concat("by", F.transform("by", lambda x: F.named_struct(F.lit("tier"), F.lit("total"), F.lit("provider"), x["provider"])))
    each = met.select("ips", F.explode("feed").alias("feed"), every.alias("by"))
    ips = each.select("ips", "feed", F.explode(F.array_distinct(F.transform("by", lambda x: x["tier"]))).alias("tier")).groupBy("feed", "tier").agg(F.sum("ips").alias("ips"))
    providers = each.select("feed", F.explode("by").alias("by")).groupBy("feed", "by.tier").agg(F.count_distinct("by.provider").alias("providers"))
    return ips.join(providers, ["feed", "tier"])


def networks_and_bogons(optimized: DataFrame, bogons: DataFrame, networks: DataFrame) -> DataFrame:
    """``feed, kind, asn, ips``: addresses in reserved space (kind ``bogon``), in each network (``network``) and in none (``unknown``).

    Every address counts once: reserved space comes before networks, and of several networks the
    least number counts. ``asn`` is 0 for what is not in a network.
    """
    met = iv.cover(feed=optimized.select("feed", "lo", "hi"), bogon=bogons.select("lo", "hi", F.lit(True).alias("any")), asn=networks.select("lo", "hi", F.col("asn").cast("long").alias("asn")))
    kind = F.when(F.size("bogon") > 0, "bogon").when(F.size("asn") > 0, "network").otherwise("unknown")
    each = met.select("ips", F.explode("feed").alias("feed"), kind.alias("kind"), F.when(kind == "network", F.array_min("asn")).otherwise(F.lit(0).cast("long")).alias("asn"))
    return each.groupBy("feed", "kind", "asn").agg(F.sum("ips").alias("ips"))


def split_bogons(optimized: DataFrame, bogons: DataFrame, networks: DataFrame) -> DataFrame:
    """``feed, feed_ips, bogon_ips, attributed_ips, unknown_ips``: the last three add up to the first."""
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("ips")).otherwise(0))
    return networks_and_bogons(optimized, bogons, networks).groupBy("feed").agg(
        F.sum("ips").alias("feed_ips"), part("bogon").alias("bogon_ips"), part("network").alias("attributed_ips"), part("unknown").alias("unknown_ips"))


def within(optimized: DataFrame, outer: DataFrame, inner: DataFrame, *keys: str) -> DataFrame:
    """Counts by ``inner`` of what lies in ``outer(lo, hi)``: the countries of one network, or the networks of one country."""
    return counts(restricted(optimized, outer), inner, *keys)


def restricted(optimized: DataFrame, outer: DataFrame) -> DataFrame:
    """The ranges of each feed that lie in ``outer(lo, hi)``."""
    met = iv.atoms(iv.stacked(feed=optimized.select("feed", "lo", "hi"), outer=outer.select("lo", "hi", F.lit(True).alias("any"))), "feed", "outer")
    return iv.optimize(met.where("size(feed) > 0 and size(outer) > 0").select(F.explode("feed").alias("feed"), "lo", "hi"))


def context(points: DataFrame, geo: DataFrame, networks: DataFrame) -> DataFrame:
    """``ip, code, asn`` of addresses ``ip``: the first country code by name or null, and the least network number, or 0."""
    at = points.where("ip is not null").select("ip", F.col("ip").alias("lo"), F.col("ip").alias("hi"))
    met = iv.atoms(iv.stacked(ip=at, code=geo.select("code", "lo", "hi"), asn=networks.select("asn", "lo", "hi")), "ip", "code", "asn").where("size(ip) > 0")
    return met.select(F.col("ip")[0].alias("ip"), F.array_min("code").alias("code"), F.coalesce(F.array_min("asn").cast("bigint"), F.lit(0).cast("bigint")).alias("asn"))


def providers(optimized: DataFrame, critical: DataFrame) -> DataFrame:
    """``feed, provider, tier, ips`` of the providers that a feed overlaps; a provider's own ranges may overlap."""
    return counts(optimized, critical, "provider", "tier")
