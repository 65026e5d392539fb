"""Comparison of all pairs, again and again: proofs that need no ranges, and a ledger of pairs known by content.

A feed's signature is its content hash, sizes and bounds; its coverage is the runs of /20 blocks that it
touches, and of /24 blocks where they are few. Both are small beside the ranges. A pair is settled by the
first of these that holds: the ledger has it; a side is empty; the bounds, the fine or the coarse blocks
are apart; both have the same content. Only what is left is compared exactly, from the ranges of the feeds
that such pairs have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators import intervals as iv
from rangeloom.sources.versions import VersionedTable, written

#: Address bits below a coarse and a fine block, and the fine blocks that a feed may have to be kept by them.
COARSE_BITS, FINE_BITS, FINE_LIMIT = 12, 8, 65_536
#: Counts as another ledger once the meaning of ``common`` changes.
ALGORITHM = 1
SIGNATURE = "feed string, sha256 string, entries long, ips long, lo long, hi long"
COVERAGE = "feed string, fine boolean, lo long, hi long"
LEDGER = "hash1 string, hash2 string, algorithm int, common long"
PLAN = ["name1", "name2", "entries1", "entries2", "ips1", "ips2", "outcome", "common"]


def signatures(optimized: DataFrame) -> DataFrame:
    """``feed, sha256, entries, ips, lo, hi``."""
    sized = iv.summary(optimized).withColumnRenamed("unique_ips", "ips").join(iv.bounds(optimized), "feed")
    return iv.content_hash(optimized).join(sized, "feed").select("feed", "sha256", "entries", "ips", "lo", "hi")


def coverage(optimized: DataFrame) -> DataFrame:
    """``feed, fine, lo, hi``: runs of block numbers that a feed touches, coarse for every feed, fine where there are few."""
    def runs(bits: int) -> DataFrame:
        return iv.optimize(optimized.select("feed", F.shiftright("lo", bits).alias("lo"), F.shiftright("hi", bits).alias("hi")))

    fine = runs(FINE_BITS)
    few = fine.groupBy("feed").agg(F.sum(iv.size()).alias("n")).where(F.col("n") <= FINE_LIMIT).select("feed")
    return runs(COARSE_BITS).select("feed", F.lit(False).alias("fine"), "lo", "hi").unionByName(fine.join(few, "feed", "left_semi").select("feed", F.lit(True).alias("fine"), "lo", "hi"))


def known(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("algorithm") == ALGORITHM).select("hash1", "hash2", F.col("common").alias("known"))


def plan(signed: DataFrame, blocks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every pair of feeds with its ``outcome`` and, unless that is ``exact``, its common addresses.

    No ranges are read. Blocks prove a pair apart only where both feeds have blocks of that size.
    """
    side = lambda k: signed.select(*(F.col(c).alias({"feed": "name"}.get(c, c) + str(k)) for c in ("feed", "sha256", "entries", "ips", "lo", "hi")))
    pairs = side(1).join(side(2), F.col("name1") < F.col("name2"))
    pairs = pairs.withColumns({"hash1": F.least("sha2561", "sha2562"), "hash2": F.greatest("sha2561", "sha2562")}).join(known(ledger), ["hash1", "hash2"], "left")
    for name, fine in (("coarse", False), ("fine", True)):
        of_size = blocks.where(F.col("fine") == fine)
        met = iv.shared(of_size).select("name1", "name2", F.lit(True).alias(f"{name}_met"))
        have = of_size.select("feed").distinct()
        pairs = (pairs.join(met, ["name1", "name2"], "left").join(have.select(F.col("feed").alias("name1"), F.lit(True).alias(f"{name}1")), "name1", "left")
                 .join(have.select(F.col("feed").alias("name2"), F.lit(True).alias(f"{name}2")), "name2", "left"))
    apart = lambda name: F.col(f"{name}_met").isNull() & F.col(f"{name}1").isNotNull() & F.col(f"{name}2").isNotNull()
    outcome = (F.when(F.col("known").isNotNull(), "ledger").when((F.col("ips1") == 0) | (F.col("ips2") == 0), "empty").when((F.col("hi1") < F.col("lo2")) | (F.col("hi2") < F.col("lo1")), "bounds")
               .when(F.col("sha2561") == F.col("sha2562"), "identical").when(apart("fine"), "fine").when(apart("coarse"), "coarse").otherwise("exact"))
    common = F.when(outcome == "ledger", F.col("known")).when(outcome == "identical", F.col("ips1")).when(outcome != "exact", F.lit(0).cast("long"))
    return pairs.select(*PLAN[:6], outcome.alias("outcome"), common.alias("common"), "hash1", "hash2")


def settled(planned: DataFrame, optimized: DataFrame) -> DataFrame:
    """The plan with the common addresses of its exact pairs; ranges of other feeds are not read."""
    exact = planned.where("outcome = 'exact'").select("name1", "name2")
    feeds = exact.select(F.col("name1").alias("feed")).union(exact.select("name2")).distinct()
    counted = iv.shared(optimized.join(feeds, "feed", "left_semi")).withColumnRenamed("common", "counted")
    joined = planned.join(counted, ["name1", "name2"], "left")
    return joined.select(*PLAN[:7], F.coalesce("common", "counted", F.lit(0).cast("long")).alias("common"), "hash1", "hash2")


class PairLedger:
    """Signatures, coverage and known pairs in a folder, kept from one update of feeds to the next."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.signed = VersionedTable(spark, f"{folder}/signatures", SIGNATURE)
        self.blocks = VersionedTable(spark, f"{folder}/coverage", COVERAGE)
        self.pairs = VersionedTable(spark, f"{folder}/pairs", LEDGER)

    def update(self, changed: DataFrame, optimized: DataFrame, gone: tuple[str, ...] = ()) -> DataFrame:
        """All pairs after some feeds got the ranges ``changed``, and others went; ``optimized`` has the ranges of all.

        Signatures and coverage of the changed feeds replace their old ones. Pairs that stay are in the
        ledger by content, so a feed that came back, or has another name, costs nothing. Pairs whose
        content no feed has any more leave the ledger.
        """
        names = changed.select("feed").distinct()
        left = lambda table: table.read().join(names, "feed", "left_anti").where(~F.col("feed").isin(list(gone)))
        signed = self.signed.replace(left(self.signed).unionByName(signatures(changed)))
        blocks = self.blocks.replace(left(self.blocks).unionByName(coverage(changed)))
        rows = written(settled(plan(signed, blocks, self.pairs.read()), optimized), "pairs")
        self.pairs.replace(rows.select("hash1", "hash2", F.lit(ALGORITHM).alias("algorithm"), "common").distinct())
        return rows.select(*PLAN)


def merged_rows(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Published rows ``feed, name, common, ...`` after fresh ones: those replace theirs, and no overlap removes a row."""
    kept = existing.join(fresh.select("feed", "name"), ["feed", "name"], "left_anti")
    return kept.unionByName(fresh).where("common > 0")


def both_ways(pairs: DataFrame) -> DataFrame:
    """``feed, name, ips, common``: each pair as a row of either feed, by falling overlap; pairs without overlap are left out."""
    one = pairs.select(F.col("name1").alias("feed"), F.col("name2").alias("name"), F.col("ips2").alias("ips"), "common")
    two = pairs.select(F.col("name2").alias("feed"), F.col("name1").alias("name"), F.col("ips1").alias("ips"), "common")
    return one.unionByName(two).where("common > 0")
