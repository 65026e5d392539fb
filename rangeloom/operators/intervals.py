"""Interval sets as rows ``(feed, lo, hi)`` with inclusive BIGINT bounds.

A range never leaves its feed, so every window here is partitioned by the feed and, where a feed
may be large, by a fixed-width bucket of the address space; ranges are clipped at bucket edges
first and joined again across the edges afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of an address bucket as a power of two: a /8 of IPv4 space.
BUCKET_BITS = 24


def clip(ranges: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """One row per range and bucket it touches, with the range cut to the bucket."""
    width = 1 << bits
    first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    return (ranges.withColumn("bucket", F.explode(F.sequence(first, last)))
            .withColumn("lo", F.greatest("lo", F.col("bucket") * width))
            .withColumn("hi", F.least("hi", F.col("bucket") * width + (width - 1))))


def _islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("lo", F.desc("hi"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ranges.withColumn("_seen", F.max("hi").over(before))
    starts = F.when(F.col("_seen").isNull() | (F.col("lo") > F.col("_seen") + 1), 1).otherwise(0)
    return (marked.withColumn("_new", starts).withColumn("_island", F.sum("_new").over(upto))
            .groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .drop("_island"))


def optimize(ranges: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Sorted, disjoint, non-adjacent ranges of each feed.

    Merges overlapping and adjacent ranges inside (feed, bucket) first, so that a large feed is
    spread over many tasks. Only ranges that touch a bucket edge can go on in the next bucket: the
    second pass takes those of a feed together, at most two for each bucket, and leaves the others
    in their buckets. Both passes see each row once, and plans that use the result several times share
    what the second one shuffles. Rows with ``lo > hi``, a null bound or a null feed are dropped.
    """
    valid = ranges.select("feed", "lo", "hi").where("feed is not null and lo <= hi")
    width = 1 << bits
    edge = (F.col("lo") % width == 0) | (F.col("hi") % width == width - 1)
    local = _islands(clip(valid, bits), ["feed", "bucket"]).withColumn("bucket", F.when(~edge, F.col("bucket")))
    return _islands(local, ["feed", "bucket"]).select("feed", "lo", "hi")


def size() -> Column:
    """Addresses in a range."""
    return F.col("hi") - F.col("lo") + 1


def summary(optimized: DataFrame) -> DataFrame:
    """Entries and unique addresses of each feed."""
    return optimized.groupBy("feed").agg(F.count(F.lit(1)).alias("entries"),
                                         F.sum(size()).alias("unique_ips"))


#: Bucket width for joins: a /16, so that the full space is 65,536 rows and dense feeds meet few ranges in one bucket.
JOIN_BITS = 16


def named(ranges: DataFrame, feed: str) -> DataFrame:
    return ranges.select(F.lit(feed).alias("feed"), "lo", "hi")


def union(ranges: DataFrame, feed: str = "union") -> DataFrame:
    """All addresses of all feeds as one feed."""
    return optimize(named(ranges, feed))


def atoms(ranges: DataFrame, *labels: str, keys: tuple[str, ...] = (), bits: int = JOIN_BITS) -> DataFrame:
    """Segments between borders, ``*keys, lo, hi`` and for each label column a sorted list of what covers the segment.

    One exchange by bucket (and ``keys``), no join: borders are numbered within their bucket, a range
    gives a cell for each segment from its first border to its last, and cells of a segment make its
    lists. A null label is nothing. A bucket has at most ``2 ** bits`` segments, whatever the input.
    """
    return swept(clip(ranges.select(*keys, *labels, "lo", "hi"), bits), labels, keys, lambda hi: hi + 1, lambda p: p - 1)


def swept(cut: DataFrame, labels: tuple[str, ...], keys: tuple[str, ...], after: Callable[[Column], Column], before: Callable[[Column], Column]) -> DataFrame:
    """The segments of ranges that are cut at buckets; ``after`` and ``before`` step from an address to its neighbours."""
    group = [*keys, "bucket"]
    ends = cut.select("*", F.explode(F.array("lo", after(F.col("hi")))).alias("p"))
    numbered = ends.withColumn("s", F.dense_rank().over(Window.partitionBy(*group).orderBy(F.asc_nulls_last("p"))))
    spans = numbered.groupBy(*group, *labels, "lo", "hi").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    inside = lambda s: F.struct(s.alias("s"), F.when(s == F.col("a"), F.col("lo")).when(s == F.col("b"), after(F.col("hi"))).alias("p"), (s < F.col("b")).alias("covers"))
    cells = spans.select(*group, *labels, F.explode(F.transform(F.sequence("a", "b"), inside)).alias("c"))
    held = cells.groupBy(*group, "c.s").agg(F.max("c.p").alias("lo"), *(F.sort_array(F.collect_set(F.when(F.col("c.covers"), F.col(x)))).alias(x) for x in labels))
    ended = held.withColumn("hi", before(F.lead("lo").over(Window.partitionBy(*group).orderBy("s"))))
    return ended.where(sum((F.size(x) for x in labels), F.lit(0)) > 0).select(*keys, "lo", "hi", *labels)


def stacked(**tables: DataFrame) -> DataFrame:
    """The ranges of several tables, each with its label in a column of its own: ``lo, hi`` and a column for each name.

    A table's label is what it has besides ``lo`` and ``hi``: its only other column, or a struct of several.
    """
    out = None
    for name, table in tables.items():
        own = [c for c in table.columns if c not in ("lo", "hi")]
        one = table.select("lo", "hi", (F.struct(*own) if len(own) > 1 else F.col(own[0])).alias(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def cover(bits: int = JOIN_BITS, **tables: DataFrame) -> DataFrame:
    """``ips`` by what covers the addresses: a row for each distinct combination of the tables' labels, as lists.

    Segments of the same combination are added up before anything is expanded from it, so what follows
    depends on the number of combinations and not on the number of ranges.
    """
    return atoms(stacked(**tables), *tables, bits=bits).groupBy(*tables).agg(F.sum(size()).alias("ips"))


def segments(left: DataFrame, right: DataFrame, bits: int = JOIN_BITS) -> DataFrame:
    """Atomic segments ``lo, hi, n_left, n_right``: how many ranges of each side cover them.

    A sweep over the borders of each bucket; borders are summed before the window sees them.
    """
    def borders(ranges: DataFrame, a: int, b: int) -> DataFrame:
        cut = clip(ranges.select("lo", "hi"), bits)
        edges = F.explode(F.array(F.struct(F.col("lo").alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct((F.col("hi") + 1).alias("p"), F.lit(-a).alias("a"), F.lit(-b).alias("b"))))
        return cut.select("bucket", edges.alias("e")).select("bucket", "e.*")

    summed = borders(left, 1, 0).unionByName(borders(right, 0, 1)).groupBy("bucket", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("bucket").orderBy("p")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (summed.select(F.col("p").alias("lo"), (F.lead("p").over(order) - 1).alias("hi"), F.sum("a").over(upto).alias("n_left"), F.sum("b").over(upto).alias("n_right"))
            .where("hi is not null"))


def intersect(left: DataFrame, right: DataFrame, feed: str = "intersect") -> DataFrame:
    return optimize(named(segments(left, right).where("n_left > 0 and n_right > 0"), feed))


def exclude(left: DataFrame, right: DataFrame, feed: str = "exclude") -> DataFrame:
    """Addresses of ``left`` that ``right`` does not have."""
    return optimize(named(segments(left, right).where("n_left > 0 and n_right = 0"), feed))


def symmetric_difference(left: DataFrame, right: DataFrame, feed: str = "diff") -> DataFrame:
    return optimize(named(segments(left, right).where("(n_left > 0) != (n_right > 0)"), feed))


def common(optimized: DataFrame, feed: str = "common") -> DataFrame:
    """Addresses that every feed has; the feeds must be optimized."""
    feeds = optimized.select("feed").distinct().groupBy().agg(F.count(F.lit(1)).alias("feeds"))
    counted = segments(optimized, optimized.where("false"))
    return optimize(named(counted.join(F.broadcast(feeds), F.col("n_left") == F.col("feeds")), feed))


def bounds(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("feed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def contains(optimized: DataFrame, points: DataFrame) -> DataFrame:
    """``ip, feed`` for every address of ``points(ip)`` and every feed that has it."""
    at = points.where("ip is not null").select(F.col("ip").alias("lo"), F.col("ip").alias("hi"), F.col("ip").alias("one"))
    found = atoms(stacked(ip=at, feed=optimized.select("feed", "lo", "hi")), "ip", "feed").where("size(ip) > 0 and size(feed) > 0")
    return found.select(F.col("ip")[0].alias("ip"), F.explode("feed").alias("feed"))


def _crossed(optimized1: DataFrame, optimized2: DataFrame) -> DataFrame:
    """``name1, name2, common`` of the feeds of two tables that share addresses."""
    both = cover(name1=optimized1.select("feed", "lo", "hi"), name2=optimized2.select("feed", "lo", "hi")).where("size(name1) > 0 and size(name2) > 0")
    pairs = both.select("ips", F.explode("name1").alias("name1"), "name2").select("ips", "name1", F.explode("name2").alias("name2"))
    return pairs.groupBy("name1", "name2").agg(F.sum("ips").alias("common"))


def shared(optimized: DataFrame) -> DataFrame:
    """``name1, name2, common`` of the feeds that share addresses, each pair once, ``name1 < name2``."""
    sets = cover(feed=optimized.select("feed", "lo", "hi")).where("size(feed) > 1")
    later = lambda x, i: F.transform(F.slice("feed", i + 2, F.size("feed")), lambda y: F.struct(x.alias("name1"), y.alias("name2")))
    return sets.select("ips", F.explode(F.flatten(F.transform("feed", later))).alias("p")).groupBy("p.name1", "p.name2").agg(F.sum("ips").alias("common"))


PAIR = ["name1", "name2", "entries1", "entries2", "ips1", "ips2"]


def _measured(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """Pairs with sizes, and their combined and common addresses; no overlap counts as 0."""
    joined = pairs.join(common, ["name1", "name2"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))
    return joined.select(*PAIR, (F.col("ips1") + F.col("ips2") - F.col("common")).alias("combined"), "common")


def compare(optimized: DataFrame) -> DataFrame:
    """All unordered pairs of feeds; the pairs are as many as the catalog's feeds make, whatever the ranges."""
    sizes = summary(optimized)
    pairs = sizes.toDF("name1", "entries1", "ips1").join(sizes.toDF("name2", "entries2", "ips2"), F.col("name1") < F.col("name2"))
    return _measured(pairs, shared(optimized))


def compare_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every feed of the first table with every feed of the second."""
    pairs = summary(before).toDF("name1", "entries1", "ips1").crossJoin(summary(after).toDF("name2", "entries2", "ips2"))
    return _measured(pairs, _crossed(before, after))


def compare_first(optimized: DataFrame, first: str) -> DataFrame:
    """``name, entries, ips, common`` of every other feed beside one feed; without that feed, none."""
    own, others = optimized.where(F.col("feed") == first), optimized.where(F.col("feed") != first)
    return compare_between(own, others).select(F.col("name2").alias("name"), F.col("entries2").alias("entries"), F.col("ips2").alias("ips"), "common")


def compare_pairs(optimized: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs ``name1, name2`` that are asked for; a name without ranges has no row."""
    wanted = wanted.select("name1", "name2").distinct()
    sizes = summary(optimized)
    pairs = wanted.join(sizes.toDF("name1", "entries1", "ips1"), "name1").join(sizes.toDF("name2", "entries2", "ips2"), "name2")
    left = optimized.join(wanted.select(F.col("name1").alias("feed")).distinct(), "feed", "left_semi")
    right = optimized.join(wanted.select(F.col("name2").alias("feed")).distinct(), "feed", "left_semi")
    return _measured(pairs, _crossed(left, right))


def compose(ranges: DataFrame, includes: list[str], excludes: list[str] = (), most: int = 20, feed: str = "composed") -> DataFrame:
    """The union of some feeds less the union of others; both lists are bounded by ``most``."""
    if not includes or max(len(includes), len(excludes)) > most:
        raise ValueError(f"from 1 to {most} feeds can be included, and up to {most} excluded")
    kept = ranges.where(F.col("feed").isin(list(includes)))
    return exclude(kept, ranges.where(F.col("feed").isin(list(excludes))), feed) if excludes else union(kept, feed)


def expression(ranges: DataFrame, text: str, feed: str = "composed") -> DataFrame:
    """A composition written as ``a + b - c``; every sign separates names."""
    signed = [(sign or "+", name.strip()) for sign, name in re.findall(r"([+-]?)([^+-]+)", text) if name.strip()]
    if not signed or signed[0][0] == "-":
        raise ValueError(f"no feed is included in {text!r}")
    return compose(ranges, [n for s, n in signed if s == "+"], [n for s, n in signed if s == "-"], feed=feed)


def exclude_next(ranges: DataFrame, before: list[str], after: list[str], feed: str = "exclude") -> DataFrame:
    """The feeds of the first list merged, less each of the second; a set less several is less their union."""
    return exclude(ranges.where(F.col("feed").isin(before)), ranges.where(F.col("feed").isin(after)), feed)


def merged(ranges: DataFrame, merges: DataFrame, states: DataFrame) -> DataFrame:
    """Curated merges: ``feed, lo, hi`` of each merge of ``merges(merge, input, subtract)``.

    ``states`` has ``feed, enabled, health``. Additive inputs that are disabled, archived or
    unmaintained are left out; a merge without an eligible input has no rows, and one with a
    subtractive input that is disabled, archived, unavailable or unknown is left out whole.
    """
    known = merges.join(states.withColumnRenamed("feed", "input"), "input", "left")
    out = F.coalesce(~F.col("enabled"), F.lit(True)) | F.coalesce(F.col("health").isin("archived", "unmaintained"), F.lit(True))
    lost = known.where(F.col("subtract") & (F.coalesce(~F.col("enabled"), F.lit(True)) | F.coalesce(F.col("health").isin("archived", "unavailable"), F.lit(True)))).select("merge").distinct()
    usable = known.where(F.col("subtract") | ~out).join(lost, "merge", "left_anti").select("merge", "input", "subtract")
    named = ranges.withColumnRenamed("feed", "input").join(usable, "input")
    edges = clip(named.select("merge", "subtract", "lo", "hi"), BUCKET_BITS)
    sign = lambda side, d: F.when(F.col("subtract") == side, d).otherwise(0)
    borders = edges.select("merge", "bucket", F.explode(F.array(*(F.struct(p.alias("p"), sign(F.lit(False), d).alias("a"), sign(F.lit(True), d).alias("b")) for p, d in ((F.col("lo"), 1), (F.col("hi") + 1, -1))))).alias("e"))
    summed = borders.groupBy("merge", "bucket", "e.p").agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))
    w = Window.partitionBy("merge", "bucket").orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = summed.select(F.col("merge").alias("feed"), F.col("p").alias("lo"), (F.lead("p").over(w) - 1).alias("hi"), F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    return optimize(kept.where("hi is not null and a > 0 and b = 0"))


def content_hash(optimized: DataFrame) -> DataFrame:
    """``feed, sha256``: of the big-endian 32-bit bounds of the ranges in order, as hexadecimal text.

    The digest is defined over a feed's whole sequence. Feeds are dealt out and sorted by Spark, and a
    task folds the batches of its partition as they come, so a feed of any size needs constant memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, names, values = None, None, [], []
        for batch in batches:
            pairs = np.stack([batch.column(c).to_numpy() for c in ("lo", "hi")], 1).astype(">u4")
            feeds = batch.column("feed")
            code = feeds.dictionary_encode()
            codes = code.indices.to_numpy()
            starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1] if len(codes) else np.zeros(0, int)
            for a, b in zip(starts, np.r_[starts[1:], len(codes)]):
                name = feeds[int(a)].as_py()
                if name != current:
                    if digest is not None:
                        names.append(current)
                        values.append(digest.hexdigest())
                    current, digest = name, hashlib.sha256()
                digest.update(pairs[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], names=["feed", "sha256"])
            names, values = [], []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([digest.hexdigest()])], names=["feed", "sha256"])

    return dealt(optimized.where("feed is not null").select("feed", "lo", "hi")).mapInArrow(run, "feed string, sha256 string")


def dealt(ranges: DataFrame) -> DataFrame:
    """Each feed whole in one partition, in order, for tasks that fold a feed's rows.

    Dealt by a hash of the feed: an exchange by the feed itself is left out where a join has dealt the rows by it
    already, and once that join turns into a broadcast, its rows are read where they lie and a feed is in several tasks.
    """
    return ranges.repartition(F.xxhash64("feed")).sortWithinPartitions("feed", "lo")


def to_cidrs(optimized: DataFrame) -> DataFrame:
    """``feed, lo, prefix``: the least aligned blocks of each range.

    A range climbs from its start by the largest block that is aligned and fits, then descends; both
    halves follow from the bits of its ends, so a range gives at most 62 rows, without a loop.
    """
    end = F.col("hi") + 1
    level = F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k")
    cut = optimized.where("lo <= hi").select("feed", "lo", end.alias("end"), level)
    width = F.expr("shiftleft(1L, k)")
    ceiling = lambda w: F.expr(f"(lo + {w} - 1) div {w} * {w}")
    floor = lambda w: F.expr(f"end div {w} * {w}")
    w, w2 = "shiftleft(1L, k)", "shiftleft(1L, k + 1)"
    # Blocks of width w that no aligned block twice as wide inside the range holds.
    inside, wider = ceiling(w) < floor(w), ceiling(w2) < floor(w2)
    starts = F.array_compact(F.array(F.when(~wider | (ceiling(w) < ceiling(w2)), ceiling(w)), F.when(~wider | (floor(w2) < floor(w)), floor(w) - width)))
    return (cut.where(inside).select("feed", F.explode(F.array_distinct(starts)).alias("lo"), (32 - F.col("k")).alias("prefix")))


def enabled_cidrs(optimized: DataFrame, prefixes: list[int]) -> DataFrame:
    """Blocks of the enabled lengths only: others are cut to the next longer one; what would need a longer one than any is dropped."""
    enabled = sorted(set(prefixes))
    if not all(0 <= p <= 32 for p in enabled):
        raise ValueError("prefix lengths are from 0 to 32")
    longer = F.lit(None).cast("int")
    for p in reversed(enabled):
        longer = F.when(F.col("prefix") <= p, F.lit(p)).otherwise(longer)
    cut = to_cidrs(optimized).withColumn("to", longer).where("to is not null")
    step = F.pow(F.lit(2.0), 32 - F.col("to")).cast("bigint")
    parts = F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), F.col("to") - F.col("prefix")).cast("bigint") - 1)
    return cut.select("feed", "lo", F.explode(parts).alias("i"), step.alias("step"), "to").select("feed", (F.col("lo") + F.col("i") * F.col("step")).alias("lo"), F.col("to").alias("prefix"))


def prefix_counts(optimized: DataFrame) -> DataFrame:
    """``feed, prefix, blocks``."""
    return to_cidrs(optimized).groupBy("feed", "prefix").agg(F.count(F.lit(1)).alias("blocks"))


def reduced_prefixes(counts: dict[int, int], percent: int, least: int) -> list[int]:
    """The lengths that stay enabled when the cheapest ones are given up until the blocks would exceed their budget.

    ``counts`` has the blocks of each length. Giving up a length turns its blocks into blocks of the
    next longer one in use; the budget is ``percent`` of the blocks, and ``least`` at least.
    """
    left = {p: n for p, n in sorted(counts.items()) if n > 0}
    total = sum(left.values())
    budget = max(total * percent // 100, least)
    while total < budget:
        used = sorted(left)
        steps = [(left[p] * ((1 << q - p) - 1), p, q) for p, q in zip(used, used[1:])]
        price, p, q = min(steps, default=(budget * 10, 0, 0))
        if price >= budget * 10 or total + price > budget:
            break
        left[q] += price + left.pop(p)
        total += price
    return sorted(left)


def reduce_prefixes(optimized: DataFrame, percent: int = 120, least: int = 16384) -> DataFrame:
    """``feed, prefix`` of the lengths that stay enabled."""
    return reduce_counts(prefix_counts(optimized), percent, least)


def reduce_counts(counts: DataFrame, percent: int, least: int) -> DataFrame:
    """``feed, prefix`` that stay enabled, from ``counts(feed, prefix, blocks)``; a feed has a row per length to decide by."""
    def decide(rows):
        import pandas as pd

        stay = reduced_prefixes(dict(zip(rows["prefix"].tolist(), rows["blocks"].tolist(), strict=True)), percent, least)
        return pd.DataFrame({"feed": [rows["feed"].iloc[0]] * len(stay), "prefix": stay})

    return counts.groupBy("feed").applyInPandas(decide, "feed string, prefix int")


def body(optimized: DataFrame, single: bool = False) -> DataFrame:
    """``feed, lo, line``: the canonical lines of a feed, blocks (an address alone without its length) or single addresses."""
    if single:
        return to_ips(optimized).select("feed", F.col("ip").alias("lo"), ip_text(F.col("ip")).alias("line"))
    length = F.when(F.col("prefix") < 32, F.concat(F.lit("/"), "prefix")).otherwise("")
    return to_cidrs(optimized).select("feed", "lo", F.concat(ip_text(F.col("lo")), length).alias("line"))


def ip_text(ip: Column) -> Column:
    """Dotted quad of an address."""
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def range_text() -> Column:
    return F.concat(ip_text(F.col("lo")), F.lit("-"), ip_text(F.col("hi")))


def ip_number(text: Column) -> Column:
    """The address of a canonical dotted quad; null for anything else."""
    part = F.split(text, r"\.")
    octets = [F.get(part, F.lit(i)).cast("long") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(text.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"), value)


def to_ips(optimized: DataFrame, most: int = 1 << 24) -> DataFrame:
    """Every single address; a range above ``most`` addresses is an error."""
    guarded = F.when(size() > most, F.raise_error(F.lit("range is too large to be expanded"))).otherwise(F.sequence("lo", "hi"))
    return optimized.select("feed", F.explode(guarded).alias("ip"))
