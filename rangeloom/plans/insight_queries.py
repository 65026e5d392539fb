"""Queries of the insight rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rangeloom.operators import attribution as at
from rangeloom.operators import history as h
from rangeloom.operators import insights as rules
from rangeloom.operators import intervals as iv
from rangeloom.plans import bindings as b
from rangeloom.plans.attribution_queries import ON, RESERVED, SHARE, _opt, _reserved, merged
from rangeloom.plans.history_queries import RUNS
from rangeloom.plans.interval_queries import OPTIMIZED, PAIRS


def _sized(s, d):
    return iv.summary(_opt(s, d)).select("feed", "unique_ips", F.substring("feed", 6, 1).alias("category"))


def _tracked(s, d):
    """Feeds of the snapshots; every other one was first seen long before its first snapshot."""
    span = b.snapshots(s, d).groupBy("feed").agg(F.min("ts").alias("started"), F.max("ts").alias("snapshot_ts"))
    return span.select("feed", F.when(F.length("feed") % 2 == 0, F.col("started")).otherwise(F.col("started") - 400 * 86400).alias("tracked_since"), "snapshot_ts")


#: Histograms of ages whose totals reach the guards: a wall, two spread ones, and one of a single age.
LISTED = """SELECT concat('l', CAST(o_custkey % 4 AS string)) AS feed, CAST(CASE o_custkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 10 < 6 THEN 1000 ELSE o_orderkey % 100 END WHEN 3 THEN 50 ELSE o_orderkey % 200 + 1 END AS bigint) AS hours, count(*) AS ips FROM orders GROUP BY 1, 2"""
#: Two policies, a few bans, and an even spread.
REMOVED = """SELECT concat('r', CAST(l_partkey % 3 AS string)) AS feed, CAST(CASE l_partkey % 3 WHEN 0 THEN CASE WHEN (l_orderkey + l_linenumber) % 10 < 8 THEN 10 ELSE 100 END WHEN 1 THEN CASE WHEN (l_orderkey * 7 + l_linenumber) % 100 = 0 THEN 1000 ELSE 10 END
  ELSE (l_orderkey + l_linenumber) % 50 + 1 END AS bigint) AS hours, count(*) AS ips FROM lineitem GROUP BY 1, 2"""
#: Many countries, one, and a few.
PLACES = """SELECT concat('g', CAST(c_custkey % 3 AS string)) AS feed, CASE c_custkey % 3 WHEN 0 THEN concat('C', CAST(CAST(floor(c_custkey / 3) AS bigint) % 60 AS string)) WHEN 1 THEN CASE WHEN c_custkey = 1 THEN 'B' ELSE 'A' END ELSE concat('D', CAST(least(c_custkey % 10, 4) AS string)) END AS code,
  CAST(sum(10) AS bigint) AS ips FROM customer GROUP BY 1, 2"""
#: Small shares, a share inside an older feed, a wide one with feeds of no category, shares of nothing, and a feed that is too small.
PEERS = """SELECT concat('p', CAST(p_partkey % 5 AS string)) AS feed, concat('q', CAST(p_partkey AS string)) AS other, CASE p_partkey % 5 WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'x' END AS category,
  CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 90) / 1000.0 WHEN 1 THEN 0.9 + (p_partkey % 90) / 1000.0 WHEN 2 THEN (p_partkey % 50) / 100.0 WHEN 3 THEN 0.0 ELSE 0.05 END AS our_share, p_partkey % 2 = 0 AS older FROM part"""


def _percentile(q: str) -> str:
    return f"min(CASE WHEN run >= {'total' if q == '1' else f'greatest(floor(total * {q}), 1)'} THEN hours END)"


def register_all(register) -> None:
    tracked = """SELECT * FROM (VALUES ('l0', 1700000000, 1703600000), ('l1', 1700000000, 1703600000), ('l2', 0, 1703600000), ('l3', 1700000000, 1703600000)) t(feed, tracked_since, snapshot_ts)"""
    register("insight_listed_age", lambda s, d: rules.listed_age(s.sql(tracked).unionByName(_tracked(s, d)), b.bound(s, d, LISTED, "orders").unionByName(h.retention_current(b.snapshots(s, d)).select("feed", "hours", "ips"))),
             f"""WITH {RUNS}, h AS ({LISTED} UNION ALL SELECT feed, (last_ts + 1800 - added_at) // 3600, count(*) FROM runs WHERE removed_at IS NULL GROUP BY 1, 2),
             t AS ({tracked} UNION ALL SELECT feed, CASE WHEN length(feed) % 2 = 0 THEN min(ts) ELSE min(ts) - 34560000 END, max(ts) FROM snap GROUP BY feed), o AS (SELECT h.*, CASE WHEN tracked_since > 0 THEN (snapshot_ts - tracked_since) // 3600 ELSE 0 END AS obs, CAST(sum(ips) OVER (PARTITION BY h.feed) AS bigint) AS total, sum(ips) OVER (PARTITION BY h.feed ORDER BY hours) AS run FROM h JOIN t ON t.feed = h.feed),
             w AS (SELECT feed, obs, total, sum(CASE WHEN hours >= greatest(floor(0.9 * obs), 1) THEN ips ELSE 0 END)::double / total AS share FROM o GROUP BY 1, 2, 3), p AS (SELECT feed, {_percentile('0.75')} AS p75, {_percentile('1')} AS p100 FROM o GROUP BY feed),
             big AS (SELECT w.*, p75, p100 FROM w JOIN p ON p.feed = w.feed WHERE total >= 100)
             SELECT feed, 'currently_listed_at_observation_wall' AS code, share AS value FROM big WHERE obs > 0 AND share >= 0.5
             UNION ALL SELECT feed, 'currently_listed_age_p75', p75 FROM big WHERE NOT (obs > 0 AND share >= 0.5) AND p75 > 0
             UNION ALL SELECT feed, 'currently_listed_age_p100', p100 FROM big WHERE NOT (obs > 0 AND share >= 0.5) AND p75 > 0 AND p75 <> p100""")
    register("insight_removed_age", lambda s, d: rules.removed_age(b.bound(s, d, REMOVED, "lineitem").unionByName(h.retention_past(b.snapshots(s, d)))),
             f"""WITH {RUNS}, h AS ({REMOVED} UNION ALL SELECT feed, (removed_at + 1800 - added_at) // 3600, count(*) FROM runs WHERE removed_at IS NOT NULL AND added_at > started GROUP BY 1, 2), o AS (SELECT *, CAST(sum(ips) OVER (PARTITION BY feed) AS bigint) AS total, sum(ips) OVER (PARTITION BY feed ORDER BY hours) AS run FROM h),
             q AS (SELECT feed, {_percentile('0.5')} AS p50, {_percentile('0.75')} AS p75, {_percentile('0.9')} AS p90, {_percentile('1')} AS p100 FROM o WHERE total >= 1000 GROUP BY feed)
             SELECT feed, 'removed_age_p75' AS code, p75::double AS value FROM q WHERE p75 > 0
             UNION ALL SELECT feed, 'multiple_retention_policies', p90 / p50 FROM q WHERE p50 > 0 AND p90 / p50 >= 5 UNION ALL SELECT feed, 'permanent_bans', p100 / p90 FROM q WHERE p90 > 0 AND p100 / p90 >= 10""")
    register("insight_countries", lambda s, d: rules.geography(b.bound(s, d, PLACES, "customer").groupBy("feed").agg(F.sum("ips").alias("unique_ips")), b.bound(s, d, PLACES, "customer")).select("feed", "code", F.round("value", 9).alias("value")),
             f"""WITH c AS ({PLACES}), k AS (SELECT feed, ips::double / sum(ips) OVER (PARTITION BY feed) AS share, row_number() OVER (PARTITION BY feed ORDER BY ips DESC, code) AS place, sum(ips) OVER (PARTITION BY feed) AS n FROM c),
             a AS (SELECT feed, count(*) AS n, max(share) AS top, sum(CASE WHEN place <= 3 THEN share END) AS top3 FROM k WHERE n >= 100 GROUP BY feed)
             SELECT feed, 'country_concentrated' AS code, round(top3, 9) AS value FROM a WHERE n >= 3 AND top3 > 0.7 AND top <= 0.95 UNION ALL SELECT feed, 'country_diverse', n FROM a WHERE n >= 50 AND top < 0.05 UNION ALL SELECT feed, 'single_country', round(top, 9) FROM a WHERE top > 0.95""")
    known = "SELECT * FROM (VALUES ('p0', 'x', 500), ('p1', 'x', 500), ('p2', '', 500), ('p3', 'x', 500), ('p4', 'x', 99)) t(feed, category, unique_ips)"
    register("insight_overlaps", lambda s, d: rules.relations(s.sql(known), b.bound(s, d, PEERS, "part")).select("feed", "code", F.round("value", 9).alias("value")),
             f"""WITH o AS (SELECT p.*, coalesce(nullif(p.category, ''), 'uncategorized') AS kind, k.category AS own FROM ({PEERS}) p JOIN ({known}) k ON k.feed = p.feed WHERE our_share > 0 AND unique_ips >= 100), x AS (SELECT feed, kind, max(our_share) AS top FROM o WHERE kind <> own GROUP BY 1, 2 HAVING count(*) >= 3 AND max(our_share) > 0.3)
             SELECT feed, 'independent' AS code, round(1 - max(our_share), 9) AS value FROM o GROUP BY feed HAVING count(*) >= 5 AND max(our_share) < 0.1
             UNION ALL SELECT feed, 'subset_of', round(max(our_share), 9) FROM o WHERE older AND our_share > 0.95 GROUP BY feed UNION ALL SELECT feed, 'cross_category_overlap', round(max(top), 9) FROM x GROUP BY feed""")
    # One series of 64 points from the order dates of each status, so that the guard of 50 updates is met.
    series = """SELECT o_orderstatus AS feed, CAST(o_custkey % 64 AS bigint) AS ts, CAST(sum(o_orderkey % 3) AS bigint) AS added, CAST(sum(o_orderkey % 2) AS bigint) AS removed,
             CAST(count(*) * CASE WHEN o_orderstatus = 'O' THEN 50 ELSE 1 END AS bigint) AS unique_ips FROM orders GROUP BY 1, 2"""
    register("insight_churn", lambda s, d: rules.churn(b.bound(s, d, series, "orders")),
             f"""WITH c AS ({series}), l AS (SELECT feed, list_sort(list((added + removed) / unique_ips)) AS s FROM c GROUP BY feed HAVING count(*) >= 50), m AS (SELECT feed, s[len(s) // 2 + 1] AS median FROM l)
             SELECT feed, CASE WHEN median > 0.5 THEN 'churn_high' ELSE 'churn_low' END AS code, median AS value FROM m WHERE median > 0.5 OR median < 0.05""")
    register("insight_size_variation", lambda s, d: rules.size_variation(b.bound(s, d, series, "orders")),
             f"""WITH c AS ({series}), l AS (SELECT feed, list_sort(list(unique_ips)) AS s FROM c GROUP BY feed HAVING count(*) >= 50)
             SELECT feed, 'size_variation' AS code, (s[len(s)] - s[1]) / s[len(s) // 2 + 1] AS value FROM l WHERE s[1] <> s[len(s)] AND s[len(s) // 2 + 1] > 0""")
    sizes = "sz AS (SELECT feed, CAST(sum(hi - lo + 1) AS bigint) AS n FROM opt GROUP BY feed)"
    register("insight_composition", lambda s, d: rules.composition(_sized(s, d), at.covered(_opt(s, d), _reserved(s), "bogon_ips"), at.tiers(_opt(s, d), b.critical(s, d))),
             f"""WITH {OPTIMIZED}, {RESERVED}, {sizes}, crit AS ({b.CRITICAL}), e AS (SELECT tier, lo, hi FROM crit UNION ALL SELECT 'total', lo, hi FROM crit), u AS {merged('e', 'tier')},
             bog AS (SELECT o.feed, {SHARE} AS ips FROM opt o JOIN res r ON {ON} GROUP BY 1), t AS (SELECT o.feed, r.tier, {SHARE} AS ips FROM opt o JOIN u r ON {ON} GROUP BY 1, 2),
             x AS (SELECT feed, max(CASE WHEN tier = 'hard' THEN ips ELSE 0 END) AS hard, max(CASE WHEN tier = 'total' THEN ips ELSE 0 END) AS total FROM t GROUP BY feed)
             SELECT bog.feed, 'bogon_present' AS code, ips::double AS value FROM bog JOIN sz ON sz.feed = bog.feed WHERE n >= 100
             UNION ALL SELECT x.feed, 'infrastructure_present', CASE WHEN hard > 0 THEN hard ELSE total END FROM x JOIN sz ON sz.feed = x.feed WHERE hard > 0 OR (n >= 100 AND (total >= 10 OR total::double / n >= 0.0001))""")
    register("insight_geography", lambda s, d: rules.geography(_sized(s, d), at.counts(_opt(s, d), b.geo(s, d).withColumn("code", F.expr("CASE WHEN code <= 'N3' THEN 'NA' ELSE code END")), "code")).select("feed", "code", F.round("value", 9).alias("value")),
             f"""WITH {OPTIMIZED}, {sizes}, geo AS (SELECT CASE WHEN code <= 'N3' THEN 'NA' ELSE code END AS code, lo, hi FROM ({b.GEO}) g), u AS {merged('geo', 'code')}, c AS (SELECT o.feed, r.code, {SHARE} AS ips FROM opt o JOIN u r ON {ON} GROUP BY 1, 2),
             k AS (SELECT c.feed, ips::double / sum(ips) OVER (PARTITION BY c.feed) AS share, row_number() OVER (PARTITION BY c.feed ORDER BY ips DESC, code) AS place FROM c JOIN sz ON sz.feed = c.feed WHERE n >= 100),
             a AS (SELECT feed, count(*) AS n, max(share) AS top, sum(CASE WHEN place <= 3 THEN share END) AS top3 FROM k GROUP BY feed)
             SELECT feed, 'country_concentrated' AS code, round(top3, 9) AS value FROM a WHERE n >= 3 AND top3 > 0.7 AND top <= 0.95 UNION ALL SELECT feed, 'country_diverse', n FROM a WHERE n >= 50 AND top < 0.05
             UNION ALL SELECT feed, 'single_country', round(top, 9) FROM a WHERE top > 0.95""")

    def facts(s, d):
        """Every feed is older than those after it, and all others are peers of another category."""
        every = _opt(s, d)
        feeds = iv.summary(every).select("feed", F.lit("peers").alias("category"), F.dense_rank().over(Window.orderBy("feed")).alias("started"))
        return rules.overlap_facts(iv.compare(every), feeds)

    register("insight_relations", lambda s, d: rules.relations(_sized(s, d).withColumn("category", F.lit("own")), facts(s, d)).select("feed", "code", F.round("value", 9).alias("value")),
             f"""{PAIRS}, w AS (SELECT name1 AS feed, name2 AS other, common::double / ips1 AS share, ips1 AS n FROM pairs UNION ALL SELECT name2, name1, common::double / ips2, ips2 FROM pairs), k AS (SELECT * FROM w WHERE n >= 100 AND share > 0)
             SELECT feed, 'independent' AS code, round(1 - max(share), 9) AS value FROM k GROUP BY feed HAVING count(*) >= 5 AND max(share) < 0.1
             UNION ALL SELECT feed, 'subset_of', round(max(share), 9) FROM k WHERE other < feed AND share > 0.95 GROUP BY feed
             UNION ALL SELECT feed, 'cross_category_overlap', round(max(share), 9) FROM k GROUP BY feed HAVING count(*) >= 3 AND max(share) > 0.3""")
