"""Queries of the IPv6 set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeloom.operators import ipv6
from rangeloom.plans import bindings as b

RAW = """SELECT concat('six_', CAST(o_custkey % 3 AS string)) AS feed, CAST(o_orderkey AS bigint) * 2654435761 % 60000 + 1 AS lo,
  CAST(o_orderkey AS bigint) * 2654435761 % 60000 + 1 + o_orderkey % 9 AS hi FROM orders"""
OPT = f"""raw AS ({RAW}), p AS (SELECT *, max(hi) OVER (PARTITION BY feed ORDER BY lo, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM raw),
g AS (SELECT *, sum(CASE WHEN ph IS NULL OR lo > ph + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY lo, hi DESC ROWS UNBOUNDED PRECEDING) AS gid FROM p),
opt AS (SELECT feed, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY feed, gid)"""
LINE = "CASE WHEN lo = hi THEN '2001:db8::' || lower(hex(lo)) ELSE '2001:db8::' || lower(hex(lo)) || '-2001:db8::' || lower(hex(hi)) END"


def _ranges(s, d):
    lines = f"SELECT feed AS key, concat('2001:DB8:0::', hex(lo), ' - 2001:db8::', lower(hex(hi))) AS line FROM ({RAW}) q"
    return ipv6.ranges(b.bound(s, d, lines, "orders"))


def register_all(register) -> None:
    register("ipv6_lines", lambda s, d: ipv6.optimize(_ranges(s, d)).select("feed", ipv6.range_text().alias("line")), f"WITH {OPT} SELECT feed, {LINE} AS line FROM opt")
    register("ipv6_common", lambda s, d: ipv6.compare(ipv6.optimize(_ranges(s, d))).select("name1", "name2", *(F.col(c).cast("bigint").alias(c) for c in ("entries1", "entries2", "ips1", "ips2", "common"))),
             f"""WITH {OPT}, sz AS (SELECT feed, count(*) AS n, CAST(sum(hi - lo + 1) AS bigint) AS ips FROM opt GROUP BY feed),
             ov AS (SELECT x.feed AS f1, y.feed AS f2, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) AS bigint) AS common FROM opt x JOIN opt y ON x.lo <= y.hi AND y.lo <= x.hi AND x.feed < y.feed GROUP BY 1, 2)
             SELECT p.feed AS name1, q.feed AS name2, p.n AS entries1, q.n AS entries2, p.ips AS ips1, q.ips AS ips2, coalesce(common, 0) AS common FROM sz p JOIN sz q ON p.feed < q.feed LEFT JOIN ov ON f1 = p.feed AND f2 = q.feed""")
    pair = "ev AS (SELECT lo AS p, CASE WHEN feed = 'six_0' THEN 1 ELSE 0 END AS da, CASE WHEN feed = 'six_1' THEN 1 ELSE 0 END AS db FROM opt UNION ALL SELECT hi + 1, CASE WHEN feed = 'six_0' THEN -1 ELSE 0 END, CASE WHEN feed = 'six_1' THEN -1 ELSE 0 END FROM opt)"
    for name, operator, where in (("ipv6_intersect", ipv6.intersect, "a > 0 AND b > 0"), ("ipv6_exclude", ipv6.exclude, "a > 0 AND b = 0"), ("ipv6_diff", ipv6.symmetric_difference, "(a > 0) <> (b > 0)")):
        def two(s, d, operator=operator):
            every = ipv6.optimize(_ranges(s, d))
            return operator(every.where("feed = 'six_0'"), every.where("feed = 'six_1'"), "x").select("feed", ipv6.range_text().alias("line"))

        register(name, two, f"""WITH {OPT}, {pair}, pt AS (SELECT p, sum(da) AS da, sum(db) AS db FROM ev GROUP BY p),
             seg AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi, sum(da) OVER (ORDER BY p) AS a, sum(db) OVER (ORDER BY p) AS b FROM pt), kept AS (SELECT lo, hi FROM seg WHERE {where}),
             k AS (SELECT lo, hi, sum(CASE WHEN ph IS NULL OR lo > ph + 1 THEN 1 ELSE 0 END) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(hi) OVER (ORDER BY lo) AS ph FROM kept) q),
             m AS (SELECT min(lo) AS lo, max(hi) AS hi FROM k GROUP BY g) SELECT 'x' AS feed, {LINE} AS line FROM m""")
    step = """step(feed, pos, hi, w) AS (SELECT feed, lo, hi, (SELECT max(1::bigint << k) FROM range(0, 33) t(k) WHERE lo % (1::bigint << k) = 0 AND lo + (1::bigint << k) - 1 <= hi) FROM opt
             UNION ALL SELECT feed, pos + w, hi, (SELECT max(1::bigint << k) FROM range(0, 33) t(k) WHERE (pos + w) % (1::bigint << k) = 0 AND pos + w + (1::bigint << k) - 1 <= hi) FROM step WHERE pos + w <= hi)"""
    register("ipv6_blocks", lambda s, d: ipv6.body(ipv6.optimize(_ranges(s, d))).select("feed", "line"),
             f"WITH RECURSIVE {OPT}, {step} SELECT feed, '2001:db8::' || lower(hex(pos)) || CASE WHEN w = 1 THEN '' ELSE '/' || CAST(128 - round(log2(w)) AS integer) END AS line FROM step WHERE w < 1000000")
    register("ipv6_compare_first", lambda s, d: ipv6.compare_first(ipv6.optimize(_ranges(s, d)), "six_1").select("name", "entries", *(F.col(c).cast("bigint").alias(c) for c in ("ips", "common"))),
             f"""WITH {OPT}, sz AS (SELECT feed, count(*) AS n, CAST(sum(hi - lo + 1) AS bigint) AS ips FROM opt GROUP BY feed),
             ov AS (SELECT y.feed, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) AS bigint) AS common FROM opt x JOIN opt y ON x.lo <= y.hi AND y.lo <= x.hi AND x.feed = 'six_1' AND y.feed <> 'six_1' GROUP BY 1)
             SELECT sz.feed AS name, n AS entries, ips, coalesce(common, 0) AS common FROM sz LEFT JOIN ov ON ov.feed = sz.feed WHERE sz.feed <> 'six_1'""")
