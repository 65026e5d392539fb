"""Queries over the graph of derived feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeloom.operators import feeds as f
from rangeloom.operators import intervals as iv
from rangeloom.operators import lineage as ln
from rangeloom.plans import bindings as b
from rangeloom.plans.interval_queries import PAIRS

FEEDS = """SELECT concat('s', CAST(k AS string)) AS feed, CASE WHEN k % 3 = 0 THEN 'secondary_merge' WHEN k % 5 = 0 THEN 'secondary_retention' ELSE 'primary' END AS provenance,
  CASE WHEN k % 7 < 2 THEN 0 ELSE 1700000000 + k * 1000 END AS source_date, CASE WHEN k % 14 = 0 THEN 0 ELSE 1690000000 + k END AS processed_date, 60 * (1 + k % 48) AS frequency_mins,
  CASE WHEN k % 4 = 0 THEN NULL ELSE k % 11 <> 0 END AS redistributable FROM (SELECT CAST(s_suppkey AS bigint) AS k FROM supplier) q"""
EDGES = """SELECT concat('s', CAST(k AS string)) AS feed, concat('s', CAST(p AS string)) AS parent, additive FROM (
  SELECT k, CAST(floor(k / 3) AS bigint) AS p, true AS additive FROM (SELECT CAST(s_suppkey AS bigint) AS k FROM supplier) q1 WHERE k % 3 = 0
  UNION ALL SELECT k, CAST(floor(k / 2) AS bigint), true FROM (SELECT CAST(s_suppkey AS bigint) AS k FROM supplier) q2 WHERE k % 3 = 0
  UNION ALL SELECT k, CAST(floor(k / 4) AS bigint), false FROM (SELECT CAST(s_suppkey AS bigint) AS k FROM supplier) q3 WHERE k % 6 = 0
  UNION ALL SELECT k, CAST(floor(k / 5) AS bigint), true FROM (SELECT CAST(s_suppkey AS bigint) AS k FROM supplier) q4 WHERE k % 5 = 0 AND k % 3 <> 0) q"""
#: A graph in which every feed has one parent, and some lead into cycles.
RINGS = "SELECT CAST(n_nationkey AS string) AS feed, CAST((n_nationkey * 3 + 1) % 25 AS string) AS parent, true AS additive FROM nation"
REACH = "reach(feed, ancestor) AS (SELECT feed, parent FROM e UNION SELECT r.feed, e.parent FROM reach r JOIN e ON e.feed = r.ancestor)"
GRAPH = f"f AS ({FEEDS}), e AS ({EDGES})"
#: Dates passed on edge by edge; the graph's feeds halve their numbers, so it is never deeper than this.
DEPTH = 14


def _dates() -> str:
    base = "CASE WHEN source_date > 0 THEN source_date ELSE processed_date END"
    rounds = [f"d0 AS (SELECT feed, {base} AS base, {base} AS changed FROM f)"]
    for i in range(DEPTH):
        rounds.append(f"d{i + 1} AS (SELECT d.feed, base, CASE WHEN coalesce(theirs, 0) > 0 THEN theirs ELSE base END AS changed FROM d{i} d LEFT JOIN (SELECT e.feed, max(p.changed) AS theirs FROM e JOIN d{i} p ON p.feed = e.parent GROUP BY e.feed) m ON m.feed = d.feed)")
    return ", ".join(rounds)


def _feeds(s, d):
    return b.bound(s, d, FEEDS, "supplier")


def _edges(s, d):
    return b.bound(s, d, EDGES, "supplier")


def register_all(register) -> None:
    leaf = "a AS (SELECT * FROM e WHERE additive), up(feed, ancestor) AS (SELECT feed, parent FROM a UNION SELECT r.feed, a.parent FROM up r JOIN a ON a.feed = r.ancestor), l AS (SELECT feed, ancestor AS leaf FROM up WHERE ancestor NOT IN (SELECT feed FROM a) UNION ALL SELECT feed, feed FROM f WHERE feed NOT IN (SELECT feed FROM a))"
    register("lineage_closure", lambda s, d: ln.closure(_edges(s, d)), f"WITH RECURSIVE {GRAPH}, {REACH} SELECT * FROM reach")
    register("lineage_leaves", lambda s, d: ln.leaves(_feeds(s, d), _edges(s, d)), f"WITH RECURSIVE {GRAPH}, {leaf} SELECT feed, leaf FROM l")
    register("lineage_related", lambda s, d: ln.related(ln.leaves(_feeds(s, d), _edges(s, d))), f"WITH RECURSIVE {GRAPH}, {leaf} SELECT DISTINCT x.feed AS name1, y.feed AS name2 FROM l x JOIN l y ON x.leaf = y.leaf AND x.feed < y.feed")
    register("lineage_dependents", lambda s, d: ln.dependents(_edges(s, d)).select("parent", F.array_join("feeds", ",").alias("feeds")), f"WITH e AS ({EDGES}) SELECT parent, string_agg(DISTINCT feed, ',' ORDER BY feed) AS feeds FROM e GROUP BY parent")
    register("lineage_redistributable", lambda s, d: ln.redistributable(_feeds(s, d), _edges(s, d)),
             f"WITH RECURSIVE {GRAPH}, {REACH}, barred AS (SELECT feed FROM f WHERE redistributable = false) SELECT feed, feed NOT IN (SELECT feed FROM barred) AND feed NOT IN (SELECT reach.feed FROM reach JOIN barred ON barred.feed = ancestor) AS redistributable FROM f")
    register("lineage_cycles", lambda s, d: ln.cycles(b.bound(s, d, RINGS, "nation")),
             f"WITH RECURSIVE e AS ({RINGS}), {REACH} SELECT min(x.ancestor) AS cycle, x.feed FROM reach x JOIN reach y ON y.feed = x.ancestor AND y.ancestor = x.feed GROUP BY x.feed")
    register("effective_changes", lambda s, d: ln.last_changes(_feeds(s, d), _edges(s, d)), f"WITH {GRAPH}, {_dates()} SELECT feed, changed FROM d{DEPTH}")
    register("effective_entries", lambda s, d: ln.effective_entries(_feeds(s, d), _edges(s, d)).drop("redistributable"),
             f"""WITH {GRAPH}, {_dates()}, one AS (SELECT feed, max(parent) AS parent FROM e GROUP BY feed HAVING count(DISTINCT parent) = 1), h AS (SELECT f.feed, p.source_date, p.frequency_mins FROM f JOIN one ON one.feed = f.feed JOIN f p ON p.feed = one.parent WHERE f.provenance = 'secondary_retention')
             SELECT f.feed, provenance, CASE WHEN changed > 0 THEN changed ELSE coalesce(h.source_date, f.source_date) END AS source_date, processed_date, coalesce(h.frequency_mins, f.frequency_mins) AS frequency_mins
             FROM f LEFT JOIN h ON h.feed = f.feed JOIN d{DEPTH} d ON d.feed = f.feed""")
    made_of = "SELECT * FROM (VALUES ('feed_AF', 'feed_AO', true), ('feed_RF', 'feed_RO', true), ('feed_RF', 'feed_NO', true), ('feed_NF', 'feed_AF', false)) t(feed, parent, additive)"

    def shares(s, d):
        every = iv.optimize(b.ranges_raw(s, d))
        feeds = iv.summary(every).select("feed", "unique_ips", F.lit("").alias("maintainer"), F.lit("primary").alias("provenance"), F.lit(False).alias("hidden"), F.lit(False).alias("reference"))
        return f.unique_share(iv.compare(every), ln.with_leaves(feeds, s.sql(made_of)))

    register("unique_share_by_lineage", shares,
             f"""{PAIRS}, both_ways AS (SELECT name1 AS feed, name2 AS peer, common FROM pairs UNION ALL SELECT name2, name1, common FROM pairs),
             kin AS (SELECT * FROM (VALUES ('feed_AF', 'feed_AO'), ('feed_RF', 'feed_RO'), ('feed_RF', 'feed_NO')) t(x, y)), ok AS (SELECT b.* FROM both_ways b WHERE NOT EXISTS (SELECT 1 FROM kin WHERE (x = feed AND y = peer) OR (y = feed AND x = peer))),
             m AS (SELECT sz.feed, ips, coalesce(max(common), 0) AS max_common, count(common) AS samples FROM sz LEFT JOIN ok ON ok.feed = sz.feed GROUP BY 1, 2)
             SELECT *, round(CASE WHEN ips = 0 THEN 0 WHEN samples = 0 THEN 100 WHEN max_common >= ips THEN 0 ELSE 100.0::double * (ips - max_common) / ips END, 4) AS percent FROM m""")
