"""Queries that compare pairs by proofs and by the ledger."""

from __future__ import annotations

from rangeloom.operators import intervals as iv
from rangeloom.operators import pairs as pr
from rangeloom.plans import bindings as b
from rangeloom.plans.interval_queries import OPTIMIZED, PAIRS
from rangeloom.sources.versions import scratch, written

#: Feeds that are apart by their bounds, by coarse or fine blocks, equal, or really overlap.
APART_RAW = """SELECT DISTINCT feed, lo, hi FROM (SELECT CASE c_nationkey % 5 WHEN 0 THEN 'near' WHEN 1 THEN 'between' WHEN 2 THEN 'wide' WHEN 3 THEN 'gaps' ELSE 'far' END AS feed,
  CASE c_nationkey % 5 WHEN 0 THEN k * 8192 WHEN 1 THEN k * 8192 + 4096 WHEN 2 THEN 2147483648 + (k % 4) * 33554432 WHEN 3 THEN 2147483648 + (k % 3) * 33554432 + 16777216 + k * 256 ELSE 4200000000 + k * 16 END AS lo,
  CASE c_nationkey % 5 WHEN 0 THEN k * 8192 + 100 WHEN 1 THEN k * 8192 + 4200 WHEN 2 THEN 2147483648 + (k % 4) * 33554432 + 16777215 WHEN 3 THEN 2147483648 + (k % 3) * 33554432 + 16777216 + k * 256 + 200 ELSE 4200000000 + k * 16 + 9 END AS hi
  FROM (SELECT CAST(c_custkey AS bigint) AS k, c_nationkey FROM customer) q1) q2
UNION ALL SELECT 'copy', k * 8192, k * 8192 + 100 FROM (SELECT CAST(c_custkey AS bigint) AS k, c_nationkey FROM customer) q3 WHERE c_nationkey % 5 = 0
UNION ALL SELECT 'mixed', k * 8192 + 50, k * 8192 + 500 FROM (SELECT CAST(c_custkey AS bigint) AS k FROM customer) q4"""
APART = OPTIMIZED.replace(b.RANGES_RAW, APART_RAW)
MEETS = "EXISTS (SELECT 1 FROM opt x JOIN opt y ON x.feed = a.feed AND y.feed = c.feed AND x.lo >> {bits} <= y.hi >> {bits} AND y.lo >> {bits} <= x.hi >> {bits})"


def _apart(s, d):
    return iv.optimize(b.bound(s, d, APART_RAW, "customer"))


def _planned(s, d):
    every = _apart(s, d)
    return pr.settled(pr.plan(pr.signatures(every), pr.coverage(every), s.createDataFrame([], pr.LEDGER)), every).select(*pr.PLAN)


def _refreshed(s, d):
    """All pairs after one feed got back the ranges that it had lost."""
    every = written(iv.optimize(b.ranges_raw(s, d)), "optimized")  # signatures, coverage and counts of both updates read it
    ledger = pr.PairLedger(s, scratch(s, "pair-ledger"))
    before = every.where("feed <> 'feed_NF' or lo % 3 <> 0")
    ledger.update(before, before)
    return ledger.update(every.where("feed = 'feed_NF'"), every)


def register_all(register) -> None:
    register("pair_plan", _planned,
             f"""WITH {APART}, sg AS (SELECT feed, count(*) AS entries, CAST(sum(hi - lo + 1) AS bigint) AS ips, min(lo) AS lo, max(hi) AS hi, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS content FROM opt GROUP BY feed),
             few AS (SELECT feed, count(DISTINCT p) <= {pr.FINE_LIMIT} AS fine FROM (SELECT feed, unnest(range(lo >> {pr.FINE_BITS}, (hi >> {pr.FINE_BITS}) + 1)) AS p FROM opt) q GROUP BY feed),
             ov AS (SELECT x.feed AS f1, y.feed AS f2, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) AS bigint) AS common FROM opt x JOIN opt y ON x.lo <= y.hi AND y.lo <= x.hi AND x.feed < y.feed GROUP BY 1, 2)
             SELECT a.feed AS name1, c.feed AS name2, a.entries AS entries1, c.entries AS entries2, a.ips AS ips1, c.ips AS ips2, CASE WHEN a.hi < c.lo OR c.hi < a.lo THEN 'bounds' WHEN a.content = c.content THEN 'identical'
               WHEN fa.fine AND fc.fine AND NOT {MEETS.format(bits=pr.FINE_BITS)} THEN 'fine' WHEN NOT {MEETS.format(bits=pr.COARSE_BITS)} THEN 'coarse' ELSE 'exact' END AS outcome, coalesce(common, 0) AS common
             FROM sg a JOIN sg c ON a.feed < c.feed JOIN few fa ON fa.feed = a.feed JOIN few fc ON fc.feed = c.feed LEFT JOIN ov ON f1 = a.feed AND f2 = c.feed""")
    register("pair_ledger_refresh", _refreshed,
             f"{PAIRS} SELECT name1, name2, entries1, entries2, ips1, ips2, CASE WHEN 'feed_NF' IN (name1, name2) THEN 'exact' ELSE 'ledger' END AS outcome, common FROM pairs")
    register("published_overlaps", lambda s, d: pr.both_ways(iv.compare(_apart(s, d))),
             f"""WITH {APART}, sz AS (SELECT feed, CAST(sum(hi - lo + 1) AS bigint) AS ips FROM opt GROUP BY feed)
             SELECT x.feed, y.feed AS name, sz.ips, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) AS bigint) AS common FROM opt x JOIN opt y ON x.lo <= y.hi AND y.lo <= x.hi AND x.feed <> y.feed JOIN sz ON sz.feed = y.feed GROUP BY 1, 2, 3""")
