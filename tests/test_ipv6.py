"""IPv6 set operators against Python sets of numbers."""

import ipaddress
import random
from decimal import Decimal

from pyspark.sql import functions as F

from rangeloom.operators import ipv6

FIRST = int(ipaddress.IPv6Address("2001:db8:0:ffff:ffff:ffff:ffff:fff0"))


def plain(rows):
    return sorted((r["feed"], (int(r["lo"]["h"]) << 64) + int(r["lo"]["l"]), (int(r["hi"]["h"]) << 64) + int(r["hi"]["l"])) for r in rows)


def islands(numbers):
    out = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(x) for x in out]


def test_texts_and_blocks(spark):
    lines = ["::", "::1", "2001:DB8::0:1", "1:0:0:2:0:0:0:3", "::ffff:1.2.3.4", "1.2.3.4", "2001:db8::/33", "10.0.0.0/8", "::/0", "1::-1::ff # note", "bad", "1:2", "2001:db8:1:2:3:4:5:6/65", "1::5-1::2"]
    got = ipv6.ranges(spark.createDataFrame([("f", x) for x in lines], "key string, line string"))
    want = []
    for x in lines[:-1]:
        x = x.split("#")[0].strip()
        try:
            if "-" in x:
                a, b = (int(ipaddress.ip_address(y)) for y in x.split("-"))
            else:
                net = ipaddress.ip_network(x, strict=False)
                a, b = int(net[0]), int(net[-1])
                if net.version == 4:
                    a, b = a + (0xFFFF << 32), b + (0xFFFF << 32)
            want.append(("f", a, b))
        except ValueError:
            pass
    assert plain(got.collect()) == sorted(want)
    texts = ["::", "::1", "2001:db8::1", "1:0:0:2::3", "1:2:3:4:5:6:7:8", "0:1::", "fe80::1:0:0:1", "1:0:2:0:3:0:4:0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:1.2.3.4"]
    shown = spark.createDataFrame([(x,) for x in texts], "t string").select("t", ipv6.text(ipv6.number(F.col("t"))).alias("s")).collect()
    assert {r["t"]: r["s"] for r in shown} == {x: "::ffff:1.2.3.4" if "." in x else str(ipaddress.IPv6Address(x)) for x in texts}


def test_set_operators_across_halves_and_buckets(spark):
    rng = random.Random(5)
    top = int(ipaddress.IPv6Address("2001:fff:ffff:ffff:ffff:ffff:ffff:fff8"))  # the end of a bucket
    pairs = [(rng.choice("ab"), base + (x := rng.randrange(40)), base + x + rng.randrange(6)) for base in (FIRST, top) for _ in range(14)]
    half = lambda n: (n >> 64, n & ipv6.TOP)
    df = spark.createDataFrame([(f, *map(str, half(a)), *map(str, half(b))) for f, a, b in pairs], "feed string, a string, b string, c string, d string")
    df = df.select("feed", ipv6.address(F.col("a"), F.col("b")).alias("lo"), ipv6.address(F.col("c"), F.col("d")).alias("hi"))
    sets = {f: {n for g, a, b in pairs if g == f for n in range(a, b + 1)} for f in "ab"}
    named = lambda feed, numbers: [(feed, *x) for x in islands(numbers)]
    assert plain(ipv6.optimize(df).collect()) == named("a", sets["a"]) + named("b", sets["b"])
    a, b = df.where("feed = 'a'"), df.where("feed = 'b'")
    for operator, numbers in ((ipv6.intersect, sets["a"] & sets["b"]), (ipv6.exclude, sets["a"] - sets["b"]), (ipv6.symmetric_difference, sets["a"] ^ sets["b"])):
        assert plain(operator(a, b, "x").collect()) == named("x", numbers)
    row = ipv6.compare(ipv6.optimize(df)).first()
    assert (int(row["ips1"]), int(row["ips2"]), int(row["common"])) == (len(sets["a"]), len(sets["b"]), len(sets["a"] & sets["b"]))


def test_least_blocks_equal_the_standard_library(spark):
    rng, top = random.Random(9), (1 << 128) - 1
    pairs = [(0, top), (0, 0), (top, top), (1, top), (0, top - 1), (1 << 64, (1 << 65) - 1), ((1 << 64) - 1, 1 << 64), (5, (1 << 64) + 5), ((3 << 64) + 7, (9 << 64) - 2), ((7 << 64), (9 << 64) - 1), ((7 << 64) + 1, (8 << 64) - 1)]
    for _ in range(60):
        a = rng.getrandbits(rng.choice((8, 63, 64, 65, 100, 128)))
        pairs.append((a, min(top, a + rng.getrandbits(rng.choice((4, 40, 64, 66, 127))))))
    shape = "feed string, lo struct<h:decimal(20,0),l:decimal(20,0)>, hi struct<h:decimal(20,0),l:decimal(20,0)>"
    split = lambda x: (Decimal(x >> 64), Decimal(x & ((1 << 64) - 1)))
    got: dict = {}
    for r in ipv6.to_blocks(spark.createDataFrame([(str(i), split(a), split(z)) for i, (a, z) in enumerate(pairs)], shape)).collect():
        got.setdefault(int(r["feed"]), set()).add((int(r["lo"]["h"]) << 64 | int(r["lo"]["l"]), r["prefix"]))
    for i, (a, z) in enumerate(pairs):
        want = {(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv6Address(a), ipaddress.IPv6Address(z))}
        assert got[i] == want, (hex(a), hex(z))


def test_lines_and_reduced_lengths(spark):
    lines = spark.createDataFrame([("f", "2001:db8::1-2001:db8::4"), ("f", "fe80::/10"), ("g", "::1")], "key string, line string")
    ranges = ipv6.optimize(ipv6.ranges(lines))
    assert sorted((r["feed"], r["line"]) for r in ipv6.body(ranges).collect()) == [("f", "2001:db8::1"), ("f", "2001:db8::2/127"), ("f", "2001:db8::4"), ("f", "fe80::/10"), ("g", "::1")]
    assert {tuple(r) for r in ipv6.reduce_prefixes(ranges, percent=100, least=5).collect()} == {("f", 10), ("f", 128), ("g", 128)}


def test_sweep_at_the_ends_of_the_space(spark):
    lines = spark.createDataFrame([("a", "::/0"), ("b", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:fff0/124"), ("b", "::5"), ("c", "::1-::9")], "key string, line string")
    rows = ipv6.compare(ipv6.optimize(ipv6.ranges(lines.where("key <> 'a'")))).collect()
    assert [(r["name1"], r["name2"], int(r["common"])) for r in rows] == [("b", "c", 1)]
    last = spark.createDataFrame([("x", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:fff8/125")], "key string, line string")
    found = ipv6.compare_between(ipv6.optimize(ipv6.ranges(last)), ipv6.optimize(ipv6.ranges(lines.where("key <> 'a'")))).collect()
    assert sorted((r["name2"], int(r["common"])) for r in found) == [("b", 8), ("c", 0)]
