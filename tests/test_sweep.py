"""The sweep over borders against sets of addresses."""

import hashlib
import random

from pyspark.sql import functions as F

from rangeloom.operators import attribution, history
from rangeloom.operators import intervals as iv
from rangeloom.sources import reference

SHAPE = "feed string, lo long, hi long"


def drawn(rng, names: str, n: int, base: int = 65_536 - 300) -> list:
    """Ranges around the border of a bucket, overlapping and repeated ones included."""
    rows = [(f, x, x + rng.randrange(40)) for f in names for x in (base + rng.randrange(600) for _ in range(n))]
    return rows + rows[:2]


def addresses(rows: list) -> dict:
    out: dict = {}
    for name, lo, hi in rows:
        out.setdefault(name, set()).update(range(lo, hi + 1))
    return out


def test_atoms_cover_what_their_lists_say(spark):
    rng = random.Random(2)
    left, right = drawn(rng, "abc", 12), drawn(rng, "xy", 9) + [("x", 0, 0xFFFFFFFF)]
    tables = iv.stacked(l=spark.createDataFrame(left, SHAPE), r=spark.createDataFrame(right[:-1], SHAPE))
    got: dict = {}
    for r in iv.atoms(tables, "l", "r").collect():
        for ip in range(r["lo"], r["hi"] + 1):
            assert ip not in got
            got[ip] = (tuple(r["l"]), tuple(r["r"]))
    a, b = addresses(left), addresses(right[:-1])
    every = set().union(*a.values(), *b.values())
    assert got == {ip: (tuple(n for n in sorted(a) if ip in a[n]), tuple(n for n in sorted(b) if ip in b[n])) for ip in every}
    whole = iv.cover(l=spark.createDataFrame(left, SHAPE), r=spark.createDataFrame(right[-1:], SHAPE)).agg(F.sum("ips")).first()[0]
    assert whole == 1 << 32


def test_pairs_points_and_history(spark):
    rng = random.Random(4)
    rows = drawn(rng, "abcde", 10)
    sets, every = addresses(rows), iv.optimize(spark.createDataFrame(rows, SHAPE).repartition(4))
    want = {(x, y): len(sets[x] & sets[y]) for x in sets for y in sets if x < y}
    assert {(r["name1"], r["name2"]): r["common"] for r in iv.compare(every).collect()} == want
    assert {r["name"]: r["common"] for r in iv.compare_first(every, "c").collect()} == {x: len(sets[x] & sets["c"]) for x in sets if x != "c"}
    points = [65_000 + rng.randrange(900) for _ in range(150)]
    got = iv.contains(every, spark.createDataFrame([(p,) for p in [*points, points[0]]] + [(None,)], "ip long")).collect()
    assert sorted(tuple(r) for r in got) == sorted({(p, n) for p in points for n in sets if p in sets[n]})
    snapshots = spark.createDataFrame([("f", 10 * ord(n), lo, hi) for n, lo, hi in rows], "feed string, ts long, lo long, hi long").transform(
        lambda df: iv.optimize(df.select(F.struct("feed", "ts").alias("feed"), "lo", "hi")).select("feed.*", "lo", "hi"))
    cut = history.pieces(snapshots).collect()
    assert {n: {x for r in cut if r["ts"] == 10 * ord(n) for x in range(r["lo"], r["hi"] + 1)} for n in sets} == sets
    assert len({(r["lo"], r["hi"]) for r in cut}) == len({r["lo"] for r in cut})


def test_optimize_joins_over_borders_and_drops_what_is_no_range(spark):
    rng = random.Random(6)
    edge = 1 << 24
    rows = [("a", edge - 5, edge + 5), ("a", edge + 6, 3 * edge), ("a", 3 * edge + 1, 3 * edge + 1), ("b", edge - 1, edge - 1), ("b", edge, edge), ("b", 5, 3), ("b", None, 4), (None, 1, 2)] + [("c", x, x + 3) for x in (edge - 200 + rng.randrange(400) for _ in range(60))]
    got: dict = {}
    for r in iv.optimize(spark.createDataFrame(rows, SHAPE)).collect():
        got.setdefault(r["feed"], []).append((r["lo"], r["hi"]))
    assert sorted(got["a"]) == [(edge - 5, 3 * edge + 1)] and got["b"] == [(edge - 1, edge)] and set(got) == {"a", "b", "c"}
    c = sorted(got["c"])
    assert {x for lo, hi in c for x in range(lo, hi + 1)} == addresses([r for r in rows if r[0] == "c"])["c"] and all(z + 1 < a for (_, z), (a, _) in zip(c, c[1:]))


def test_attribution_counts_each_address_once(spark):
    rng = random.Random(8)
    rows, nets = drawn(rng, "abc", 8), [(n, lo, hi) for n, (_, lo, hi) in zip([5, 6, 7, 5, 6, 7, 5], drawn(rng, "q", 5))]
    bogon = [(65_500, 65_560), (65_550, 65_600)]
    sets, every = addresses(rows), iv.optimize(spark.createDataFrame(rows, SHAPE))
    asns, dark = addresses(nets), {x for lo, hi in bogon for x in range(lo, hi + 1)}
    networks, reserved = spark.createDataFrame(nets, "asn int, lo long, hi long"), spark.createDataFrame(bogon, "lo long, hi long")
    assert {(r["feed"], r["asn"]): r["ips"] for r in attribution.counts(every, networks, "asn").collect()} == {(f, n): len(sets[f] & asns[n]) for f in sets for n in asns if sets[f] & asns[n]}
    known = set().union(*asns.values())
    shares = {(r["feed"], r["asn"]): (r["ips"], r["percent"]) for r in attribution.network_shares(every, networks).collect()}
    assert shares == {(f, n): (k, round(100 * k / len(sets[f]), 4)) for f in sets for n, k in [*((n, len(sets[f] & asns[n])) for n in asns), (0, len(sets[f] - known))] if k}
    split = {(r["feed"], r["kind"], r["asn"]): r["ips"] for r in attribution.networks_and_bogons(every, reserved, networks).collect()}
    least = lambda x: min(n for n in asns if x in asns[n])
    want: dict = {}
    for f, ips in sets.items():
        for x in ips:
            key = (f, "bogon", 0) if x in dark else (f, "network", least(x)) if x in known else (f, "unknown", 0)
            want[key] = want.get(key, 0) + 1
    assert split == want


def test_country_segments_of_thousands_of_borders_in_one_bucket(spark):
    rng = random.Random(10)
    rows = [(f"C{i % 40}", x, x + rng.randrange(1, 60)) for i, x in enumerate(rng.randrange(60_000) for _ in range(3000))]
    got: dict = {}
    for r in reference.flattened(spark.createDataFrame(rows, "code string, lo long, hi long")).collect():
        for x in range(r["lo"], r["hi"] + 1):
            got[x] = r["codes"]
    want: dict = {}
    for code, ips in addresses(rows).items():
        for x in ips:
            want.setdefault(x, []).append(code)
    assert got == {x: sorted(codes) for x, codes in want.items()}


def test_content_hash_streams_batches(spark):
    rows = [(f, 3 * i, 3 * i + 1) for f, n in (("one", 1), ("few", 7), ("many", 25_000)) for i in range(n)]
    got = {r["feed"]: r["sha256"] for r in iv.content_hash(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()}
    for f in got:
        assert got[f] == hashlib.sha256(b"".join(lo.to_bytes(4, "big") + hi.to_bytes(4, "big") for g, lo, hi in rows if g == f)).hexdigest()
    assert len(got) == 3 and iv.content_hash(spark.createDataFrame([], SHAPE)).count() == 0
