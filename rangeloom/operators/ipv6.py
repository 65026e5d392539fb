"""IPv6 interval sets as rows ``(feed, lo, hi)``; an address is a struct of two DECIMAL(20,0) halves.

Structs compare field by field, so minima, maxima and windows over ``lo`` and ``hi`` work as for IPv4.
A bucket is the first bits of the upper half; ranges are cut at bucket borders as the IPv4 ones are.
IPv4 addresses enter as mapped ones, ``::ffff:0:0/96``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions.addresses import QUAD, _ipv6_shape, ipv4_number, let
from rangeloom.operators import intervals as iv

#: 2 to the power of 64, less one: the largest half.
TOP = (1 << 64) - 1
HALF = "decimal(20,0)"


def half(value: int) -> Column:
    return F.lit(str(value)).cast(HALF)


def address(h: Column, low: Column) -> Column:
    return F.struct(h.cast(HALF).alias("h"), low.cast(HALF).alias("l"))


def following(ip: Column) -> Column:
    """The next address; the last one has none."""
    return F.when(ip["l"] < half(TOP), address(ip["h"], ip["l"] + 1)).when(ip["h"] < half(TOP), address(ip["h"] + 1, half(0)))


def number(text: Column) -> Column:
    """The address of an IPv6 text, or of a dotted quad as a mapped one; null for anything else."""
    as_groups = lambda x: F.concat(F.hex(F.floor(x / 65536)), F.lit(":"), F.hex(F.pmod(x, F.lit(65536))))
    quad = let(ipv4_number(F.regexp_extract(text, f"({QUAD})$", 1)), as_groups)
    plain = F.when(text.rlike(f"(?:^|:){QUAD}$"), F.concat(F.when(text.contains(":"), F.regexp_replace(text, f"{QUAD}$", "")).otherwise(F.lit("::ffff:")), quad)).otherwise(text)

    def joined(t: Column) -> Column:
        sides = F.split(t, "::", -1)
        groups = lambda side: F.filter(F.split(side, ":", -1), lambda g: g != "")
        front, back = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        digits = F.concat(F.transform(front, lambda g: F.lpad(g, 4, "0")), F.array_repeat(F.lit("0000"), 8 - F.size(front) - F.size(back)), F.transform(back, lambda g: F.lpad(g, 4, "0")))
        value = lambda a: F.conv(F.array_join(F.slice(digits, a, 4), ""), 16, 10)
        return F.when(_ipv6_shape(t), address(value(1), value(5)))

    return let(plain, joined)


def text(ip: Column) -> Column:
    """The canonical text: lower case, no zeros in front, and the first longest run of two or more zero groups as ``::``; mapped addresses end in a dotted quad."""
    hex_half = lambda x: F.lpad(F.lower(F.conv(x.cast("string"), 10, 16)), 16, "0")

    def shortened(joined: Column) -> Column:
        out = joined
        for n in range(2, 9):
            run = rf"^(.*?)(?:^|:){':'.join('0' * n)}(?:$|:)(.*)$"
            out = F.when(joined.rlike(run), F.regexp_replace(joined, run, "$1::$2")).otherwise(out)
        return out

    def shown(h: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(h, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        quad = lambda low: F.concat_ws(".", *(F.shiftright(low, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
        return F.when(F.startswith(h, F.lit("0" * 20 + "ffff")), F.concat(F.lit("::ffff:"), let(F.conv(F.substring(h, 25, 8), 16, 10).cast("bigint"), quad))).otherwise(let(F.array_join(groups, ":"), shortened))

    return let(F.concat(hex_half(ip["h"]), hex_half(ip["l"])), shown)


def block(ip: Column, prefix: Column) -> Column:
    """``lo, hi`` of the block of a prefix length that holds an address."""
    # Doubles can't hold these powers of two as decimals exactly; binary digits can.
    width = lambda bits: F.conv(F.concat(F.lit("1"), F.repeat(F.lit("0"), bits)), 2, 10).cast(HALF)

    def cut(x: Column, bits: Column) -> tuple[Column, Column]:
        lo = F.when(bits >= 64, half(0)).otherwise(x - x % width(F.least(bits, F.lit(63))))
        return lo, F.when(bits >= 64, half(TOP)).otherwise(lo + width(F.least(bits, F.lit(63))) - 1)

    (h_lo, h_hi), (l_lo, l_hi) = cut(ip["h"], F.greatest(64 - prefix, F.lit(0))), cut(ip["l"], F.least(128 - prefix, F.lit(64)))
    return F.struct(address(h_lo, l_lo).alias("lo"), address(h_hi, l_hi).alias("hi"))


def endpoint(token: Column) -> Column:
    """``lo, hi`` of an address or block."""
    ip = number(F.substring_index(token, "/", 1))
    bits = F.when(F.instr(token, "/") == 0, 128).otherwise(F.regexp_extract(token, r"/([0-9]{1,3})$", 1).try_cast("int"))
    bits = F.when(F.substring_index(token, "/", 1).rlike(f"^{QUAD}$") & (F.instr(token, "/") > 0), bits + 96).otherwise(bits)
    return let(F.struct(ip.alias("ip"), bits.alias("bits")), lambda x: F.when(x["ip"].isNotNull() & (x["bits"] <= 128), block(x["ip"], x["bits"])))


def size() -> Column:
    """Addresses of a range as DECIMAL(38,0); null for more than that holds, which only ranges of over a quarter of the space have."""
    full = F.lit(str(1 << 64)).cast("decimal(20,0)")
    high = F.try_multiply((F.col("hi.h") - F.col("lo.h")).cast(HALF), full).cast("decimal(38,0)")
    return F.try_add(high, (F.col("hi.l") - F.col("lo.l") + 1).cast("decimal(38,0)"))


def _touches(before: Column, lo: Column) -> Column:
    """Whether a range that starts at ``lo`` overlaps or follows one that ends at ``before``."""
    return (lo <= before) | (lo == following(before))


#: Addresses of a bucket in the upper half: its first 20 bits.
BUCKET = 1 << 44


def clip(ranges: DataFrame) -> DataFrame:
    """One row per range and bucket it touches, with the range cut to the bucket."""
    bucket = lambda ip: F.floor(ip["h"] / half(BUCKET)).cast("bigint")
    at = F.col("bucket").cast(HALF) * half(BUCKET)
    cut = ranges.where("lo <= hi").withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    return (cut.withColumn("lo", F.greatest("lo", address(at, half(0)))).withColumn("hi", F.least("hi", address(at + half(BUCKET - 1), half(TOP)))))


def _islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("lo", F.desc("hi"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = ranges.select(*keys, "lo", "hi", F.max("hi").over(before).alias("seen"))
    new = F.when(F.col("seen").isNull() | ~F.coalesce(_touches(F.col("seen"), F.col("lo")), F.lit(False)), 1).otherwise(0)
    return (marked.withColumn("island", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island"))


def optimize(ranges: DataFrame) -> DataFrame:
    """Sorted, disjoint, non-adjacent ranges of each feed; reversed and null ranges are dropped.

    Ranges merge inside (feed, bucket) first; only those at a bucket's border can go on in the next one. Of ranges with
    the same start only the longest counts, so a window sorts the starts of a bucket and not its rows. An address is one
    number there, its distance from the bucket's first, as Spark reduces numbers by hash and structs by a sort of all rows.
    """
    start, full = F.col("bucket").cast(HALF) * half(BUCKET), F.lit(str(1 << 64)).cast(HALF)
    distance = lambda ip: ((ip["h"] - start).cast(HALF) * full + ip["l"]).cast("decimal(38,0)")
    place = lambda x: address(start + F.expr(f"{x} div {1 << 64}BD"), F.col(x) % full)
    cut = clip(ranges.select("feed", "lo", "hi")).select("feed", "bucket", distance(F.col("lo")).alias("a"), distance(F.col("hi")).alias("z"))
    longest = cut.groupBy("feed", "bucket", "a").agg(F.max("z").alias("z"))
    local = _islands(longest.select("feed", "bucket", place("a").alias("lo"), place("z").alias("hi")), ["feed", "bucket"])
    first = (F.col("lo.l") == half(0)) & (F.col("lo.h") % half(BUCKET) == half(0))
    last = (F.col("hi.l") == half(TOP)) & (F.col("hi.h") % half(BUCKET) == half(BUCKET - 1))
    across = _islands(local.where(first | last).select("feed", "lo", "hi"), ["feed"])
    return local.where(~(first | last)).select("feed", "lo", "hi").unionByName(across.select("feed", "lo", "hi"))


def summary(optimized: DataFrame) -> DataFrame:
    return optimized.groupBy("feed").agg(F.count(F.lit(1)).alias("entries"), F.sum(size()).alias("unique_ips"))


def segments(left: DataFrame, right: DataFrame) -> DataFrame:
    """Atomic segments ``lo, hi, n_left, n_right`` of each bucket, from a sweep over its borders."""
    def borders(ranges: DataFrame, a: int, b: int) -> DataFrame:
        ends = F.array(F.struct(F.col("lo").alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(following(F.col("hi")).alias("p"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))
        return clip(ranges.select("lo", "hi")).select("bucket", F.explode(ends).alias("e")).select("bucket", "e.*")

    summed = borders(left, 1, 0).unionByName(borders(right, 0, 1)).groupBy("bucket", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_last("p"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.lead("p").over(order)
    closed = summed.select("p", after.alias("q"), F.sum("a").over(upto).alias("n_left"), F.sum("b").over(upto).alias("n_right")).where("p is not null and (n_left > 0 or n_right > 0)")
    q = F.col("q")
    last = F.when(q.isNull(), address(half(TOP), half(TOP))).when(q["l"] > 0, address(q["h"], q["l"] - 1)).otherwise(address(q["h"] - 1, half(TOP)))
    return closed.select(F.col("p").alias("lo"), last.alias("hi"), "n_left", "n_right")


def preceding(ip: Column) -> Column:
    """The address before; the last address for the null that follows it."""
    return F.when(ip.isNull(), address(half(TOP), half(TOP))).when(ip["l"] > half(0), address(ip["h"], ip["l"] - 1)).otherwise(address(ip["h"] - 1, half(TOP)))


def atoms(ranges: DataFrame, *labels: str) -> DataFrame:
    """Segments ``lo, hi`` and for each label column a sorted list of what covers them, by one sweep as for IPv4."""
    return iv.swept(clip(ranges.select(*labels, "lo", "hi")), labels, (), following, preceding)


def contains(optimized: DataFrame, points: DataFrame) -> DataFrame:
    """``ip, feed`` for every address of ``points(ip)`` and every feed that has it."""
    at = points.where("ip is not null").select(F.col("ip").alias("lo"), F.col("ip").alias("hi"), F.col("ip").alias("one"))
    found = atoms(iv.stacked(ip=at, feed=optimized.select("feed", "lo", "hi")), "ip", "feed").where("size(ip) > 0 and size(feed) > 0")
    return found.select(F.col("ip")[0].alias("ip"), F.explode("feed").alias("feed"))


def cover(**tables: DataFrame) -> DataFrame:
    """``ips`` by the combination of labels that covers the addresses; null beyond 38 digits."""
    return atoms(iv.stacked(**tables), *tables).groupBy(*tables).agg(F.sum(size()).alias("ips"))


def compare(optimized: DataFrame) -> DataFrame:
    """All unordered pairs of feeds with their sizes and common addresses; no overlap counts as 0."""
    sizes = summary(optimized)
    sets = cover(feed=optimized.select("feed", "lo", "hi")).where("size(feed) > 1")
    later = lambda x, i: F.transform(F.slice("feed", i + 2, F.size("feed")), lambda y: F.struct(x.alias("name1"), y.alias("name2")))
    shared = sets.select("ips", F.explode(F.flatten(F.transform("feed", later))).alias("p")).groupBy("p.name1", "p.name2").agg(F.sum("ips").alias("common"))
    pairs = sizes.toDF("name1", "entries1", "ips1").join(sizes.toDF("name2", "entries2", "ips2"), F.col("name1") < F.col("name2"))
    return pairs.join(shared, ["name1", "name2"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("decimal(38,0)")))


def compare_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every feed of the first table with every feed of the second."""
    both = cover(name1=before.select("feed", "lo", "hi"), name2=after.select("feed", "lo", "hi")).where("size(name1) > 0 and size(name2) > 0")
    common = both.select("ips", F.explode("name1").alias("name1"), "name2").select("ips", "name1", F.explode("name2").alias("name2")).groupBy("name1", "name2").agg(F.sum("ips").alias("common"))
    pairs = summary(before).toDF("name1", "entries1", "ips1").crossJoin(summary(after).toDF("name2", "entries2", "ips2"))
    return pairs.join(common, ["name1", "name2"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("decimal(38,0)")))


def compare_first(optimized: DataFrame, first: str) -> DataFrame:
    """``name, entries, ips, common`` of every other feed beside one feed."""
    found = compare_between(optimized.where(F.col("feed") == first), optimized.where(F.col("feed") != first))
    return found.select(F.col("name2").alias("name"), F.col("entries2").alias("entries"), F.col("ips2").alias("ips"), "common")


def _blocks64(parts: DataFrame) -> DataFrame:
    """``feed, other, upper, x, k``: the least aligned blocks of ``2 ** k`` of the ranges from ``x`` up to below ``end`` of one half."""
    power = F.array(*(half(1 << k) for k in range(66)))
    at = lambda shift: F.element_at(power, F.col("k") + 1 + shift)
    cut = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k")).select("*", at(0).alias("w"), at(1).alias("w2"))
    up = lambda w: (F.col("x") + F.pmod(F.col(w) - F.col("x") % F.col(w), F.col(w))).cast("decimal(21,0)")
    down = lambda w: (F.col("end") - F.col("end") % F.col(w)).cast("decimal(21,0)")
    edges = cut.select("feed", "other", "upper", "k", "w", up("w").alias("c"), down("w").alias("f"), up("w2").alias("c2"), down("w2").alias("f2")).where("c < f")
    wider = F.col("c2") < F.col("f2")
    starts = F.array_compact(F.array(F.when(~wider | (F.col("c") < F.col("c2")), F.col("c")), F.when(~wider | (F.col("f2") < F.col("f")), (F.col("f") - F.col("w")).cast("decimal(21,0)"))))
    return edges.select("feed", "other", "upper", F.explode(F.array_distinct(starts)).alias("x"), "k").withColumn("x", F.col("x").cast(HALF))


def to_blocks(optimized: DataFrame) -> DataFrame:
    """``feed, lo, prefix``: the least aligned blocks of each range.

    A range is a part at its start and one at its end that share their upper half, and whole upper halves
    between them; no block crosses from one part to another, so each is cut within its own half.
    """
    lo, hi = F.col("lo"), F.col("hi")
    first = F.when(lo["l"] == half(0), lo["h"]).otherwise(lo["h"] + 1).cast("decimal(21,0)")
    last = F.when(hi["l"] == half(TOP), hi["h"] + 1).otherwise(hi["h"]).cast("decimal(21,0)")  # the end of the whole halves
    part = lambda other, upper, x, end: F.struct(other.cast(HALF).alias("other"), F.lit(upper).alias("upper"), x.cast("decimal(21,0)").alias("x"), end.cast("decimal(21,0)").alias("end"))
    full = F.lit(str(1 << 64)).cast("decimal(21,0)")
    same = lo["h"] == hi["h"]
    parts = F.array_compact(F.array(
        F.when(same & (first >= last), part(lo["h"], False, lo["l"], hi["l"] + 1)),
        F.when(~same & (lo["l"] > half(0)), part(lo["h"], False, lo["l"], full)),
        F.when(first < last, part(half(0), True, first, last)),
        F.when(~same & (hi["l"] < half(TOP)), part(hi["h"], False, half(0), hi["l"] + 1))))
    cut = _blocks64(optimized.where("lo <= hi").select("feed", F.explode(parts).alias("p")).select("feed", "p.*"))
    ip = F.when(F.col("upper"), address(F.col("x"), half(0))).otherwise(address(F.col("other"), F.col("x")))
    return cut.select("feed", ip.alias("lo"), F.when(F.col("upper"), 64 - F.col("k")).otherwise(128 - F.col("k")).alias("prefix"))


def body(optimized: DataFrame) -> DataFrame:
    """``feed, lo, line``: the canonical lines of a feed; a block of one address has no length."""
    length = F.when(F.col("prefix") < 128, F.concat(F.lit("/"), "prefix")).otherwise("")
    return to_blocks(optimized).select("feed", "lo", F.concat(text(F.col("lo")), length).alias("line"))


def prefix_counts(optimized: DataFrame) -> DataFrame:
    """``feed, prefix, blocks``."""
    return to_blocks(optimized).groupBy("feed", "prefix").agg(F.count(F.lit(1)).alias("blocks"))


def reduce_prefixes(optimized: DataFrame, percent: int = 120, least: int = 16384) -> DataFrame:
    """``feed, prefix`` of the lengths that stay enabled; a feed has at most 129 rows to decide by."""
    return iv.reduce_counts(prefix_counts(optimized), percent, least)


def ranges(lines: DataFrame) -> DataFrame:
    """``feed, lo, hi`` of lines ``key, line``: an address, a block, or ``first-last``; IPv4 enters as mapped, other lines are dropped."""
    bare = F.trim(F.regexp_replace("line", "[#;].*$", ""))
    cut = lines.select("key", bare.alias("line"))
    left, right = F.trim(F.substring_index("line", "-", 1)), F.trim(F.expr("substring(line, instr(line, '-') + 1)"))
    split = F.instr("line", "-") > 1
    # Exploded from an array of one, as the filter below would read each end anew for every use of it.
    ends = F.struct(split.alias("split"), endpoint(F.when(split, left).otherwise(F.col("line"))).alias("a"), F.when(split, endpoint(right)).alias("b"))
    found = cut.select("key", F.explode(F.array(ends)).alias("e")).select("key", "e.*")
    placed = found.select(F.col("key").alias("feed"), F.col("a.lo").alias("lo"), F.when(F.col("split"), F.col("b.hi")).otherwise(F.col("a.hi")).alias("hi"))
    return placed.where("lo is not null and hi is not null and lo <= hi")


def _named(found: DataFrame, feed: str) -> DataFrame:
    return optimize(found.select(F.lit(feed).alias("feed"), "lo", "hi"))


def union(ranges: DataFrame, feed: str = "union") -> DataFrame:
    return _named(ranges, feed)


def intersect(left: DataFrame, right: DataFrame, feed: str = "intersect") -> DataFrame:
    return _named(segments(left, right).where("n_left > 0 and n_right > 0"), feed)


def exclude(left: DataFrame, right: DataFrame, feed: str = "exclude") -> DataFrame:
    return _named(segments(left, right).where("n_left > 0 and n_right = 0"), feed)


def symmetric_difference(left: DataFrame, right: DataFrame, feed: str = "diff") -> DataFrame:
    return _named(segments(left, right).where("(n_left > 0) <> (n_right > 0)"), feed)


def range_text() -> Column:
    """``first-last``, or an address alone."""
    return F.concat(text(F.col("lo")), F.when(F.col("lo") == F.col("hi"), F.lit("")).otherwise(F.concat(F.lit("-"), text(F.col("hi")))))
