"""Queries over the feed catalog and over pairs of feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeloom.operators import feeds as f
from rangeloom.operators import history as h
from rangeloom.operators import intervals as iv
from rangeloom.plans import bindings as b
from rangeloom.plans.history_queries import RUNS, _churn
from rangeloom.plans.interval_queries import PAIRS

CATEGORY = lambda i: "CASE category " + " ".join(f"WHEN '{c}' THEN {v[i]}" for c, v in f.CADENCE_OF.items()) + f" ELSE {f.OTHER_CADENCE[i]} END"
HEALTH = f"""cat AS ({b.CATALOG}), hc AS (SELECT *, greatest(failing_mins, idle_mins) AS worst, {CATEGORY(0)} AS healthy_mins, {CATEGORY(1)} AS risky_mins FROM cat),
hf AS (SELECT *, CASE WHEN observed <= 1 THEN greatest(2 * risky_mins, {f.GRACE_MINS}) ELSE 2 * risky_mins END AS fail_mins, observed <= 1 AND idle_mins > 0 AND idle_mins < {f.GRACE_MINS} AS grace FROM hc),
hl AS (SELECT * EXCLUDE (worst, healthy_mins, risky_mins, fail_mins, grace), CASE WHEN NOT published THEN 'unavailable' WHEN failing_mins > 0 AND worst >= fail_mins AND worst - fail_mins >= {f.ARCHIVAL_MINS} THEN 'archived'
  WHEN failing_mins > 0 AND worst >= fail_mins THEN 'unavailable' WHEN entries = 0 THEN 'empty' WHEN age_excluded OR grace THEN 'healthy' WHEN idle_mins >= 2 * risky_mins THEN 'unmaintained'
  WHEN idle_mins >= risky_mins THEN 'risky' WHEN idle_mins > greatest(avg_update_mins, healthy_mins) THEN 'delayed' ELSE 'healthy' END AS health FROM hf)"""
BINS = "CASE " + " ".join(f"WHEN avg_update_mins < {m} THEN '{n}'" for m, n in f.CADENCES) + " ELSE '>4w' END"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(maintainer), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unknown')"


def register_all(register) -> None:
    health = lambda s, d: f.health(b.catalog(s, d))
    register("health_class", lambda s, d: health(s, d).select("feed", "health"), f"WITH {HEALTH} SELECT feed, health FROM hl")
    register("cadence_bins", lambda s, d: b.catalog(s, d).groupBy(f.cadence(F.col("avg_update_mins")).alias("cadence")).count().withColumnRenamed("count", "feeds"),
             f"WITH {HEALTH} SELECT {BINS} AS cadence, count(*) AS feeds FROM cat GROUP BY 1")
    for name, times in (("retry_delay", 1), ("retry_delay_of_rare_feeds", 40)):
        doubled = " ".join(f"WHEN observed > {k} AND base * {1 << k - 1} >= {f.RETRY_CAP} THEN {f.RETRY_CAP} WHEN observed > {k} AND base * {1 << k} >= every THEN every" for k in range(1, 5))
        register(name, lambda s, d, times=times: health(s, d).select("feed", f.retry_mins(F.col("avg_update_mins") * times, F.col("observed"), F.col("health").isin("unmaintained", "archived")).alias("retry_mins")),
                 f"""WITH {HEALTH}, g AS (SELECT feed, health, observed, greatest(avg_update_mins * {times}, 1) AS every, CAST(ceil(greatest(avg_update_mins * {times}, 1) / 16) AS bigint) AS base FROM hl)
                 SELECT feed, CAST(CASE WHEN observed < 1 THEN every WHEN health IN ('unmaintained', 'archived') THEN least(base * pow(2, observed - 1), {f.RETRY_CAP}) {doubled} ELSE least(base * pow(2, observed - 1), every, {f.RETRY_CAP}) END AS bigint) AS retry_mins FROM g""")
    for name, key in (("category_rollup", "category"), ("country_index", "country"), ("asn_index", "asn")):
        register(name, lambda s, d, key=key: f.rollup(health(s, d).where("health in ('healthy', 'delayed')"), key),
                 f"""WITH {HEALTH} SELECT {key}, count(*) AS feeds, CAST(sum(unique_ips) AS bigint) AS ips, count(DISTINCT CASE WHEN maintainer <> '' THEN maintainer END) AS maintainers
                 FROM hl WHERE health IN ('healthy', 'delayed') GROUP BY 1""")
    register("maintainer_index", lambda s, d: b.catalog(s, d).groupBy(f.slug(F.col("maintainer")).alias("slug")).agg(F.count(F.lit(1)).alias("feeds"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories")),
             f"WITH {HEALTH} SELECT {SLUG} AS slug, count(*) AS feeds, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM cat GROUP BY 1")
    register("top_n_other", lambda s, d: f.top_with_other(b.catalog(s, d).groupBy("country").agg(F.sum("unique_ips").alias("ips")), "country", "ips", 5),
             f"""WITH {HEALTH}, t AS (SELECT country, CAST(sum(unique_ips) AS bigint) AS ips, row_number() OVER (ORDER BY sum(unique_ips) DESC, country) AS n FROM cat GROUP BY country)
             SELECT country, ips FROM t WHERE n <= 5 UNION ALL SELECT 'other', CAST(sum(ips) AS bigint) FROM t WHERE n > 5 HAVING count(*) > 0""")
    shared = lambda s, d: health(s, d).withColumns({"unique_share_pct": F.expr("CAST(feed_no % 100 AS double)"), "redistributable": F.expr("feed_no % 2 = 0"), "license": F.expr("CASE feed_no % 3 WHEN 0 THEN 'CC-BY' ELSE 'none' END")})
    register("find_feeds", lambda s, d: f.find(shared(s, d), search="supplier CO.", category="Policy_Risk", size_min=100).select("feed", "health", "unique_ips"),
             f"WITH {HEALTH} SELECT feed, health, unique_ips FROM hl WHERE contains(lower(concat_ws(' ', feed, maintainer)), 'supplier') AND contains(lower(concat_ws(' ', feed, maintainer)), 'co.') AND category = 'policy_risk' AND unique_ips >= 100")
    register("find_shared_feeds", lambda s, d: f.find(shared(s, d), maintainer="maintainer", redistributable=True, uniqueness_in="low", size_max=4000, license="none").select("feed", "unique_share_pct"),
             f"WITH {HEALTH} SELECT feed, CAST(feed_no % 100 AS double) AS unique_share_pct FROM hl WHERE contains(lower(maintainer), 'maintainer') AND feed_no % 2 = 0 AND feed_no % 100 > 0 AND feed_no % 100 < 5 AND unique_ips <= 4000 AND feed_no % 3 <> 0")
    feeds = lambda s, d: iv.summary(iv.optimize(b.ranges_raw(s, d))).select("feed", "unique_ips", F.expr("CASE WHEN feed LIKE 'feed_A%' THEN 'Shared Co.' ELSE '' END AS maintainer"),
        F.lit("primary").alias("provenance"), (F.col("feed") == "feed_NF").alias("hidden"), F.lit(False).alias("reference"), F.array(F.expr("CASE WHEN feed LIKE 'feed_R%' THEN 'leaf_r' ELSE feed END")).alias("leaves"))
    register("unique_share", lambda s, d: f.unique_share(iv.compare(iv.optimize(b.ranges_raw(s, d))), feeds(s, d)),
             f"""{PAIRS}, both_ways AS (SELECT name1 AS feed, name2 AS peer, common FROM pairs UNION ALL SELECT name2, name1, common FROM pairs),
             ok AS (SELECT * FROM both_ways WHERE peer <> 'feed_NF' AND NOT (feed LIKE 'feed_A%' AND peer LIKE 'feed_A%') AND NOT (feed LIKE 'feed_R%' AND peer LIKE 'feed_R%')),
             m AS (SELECT sz.feed, ips, coalesce(max(common), 0) AS max_common, count(common) AS samples FROM sz LEFT JOIN ok ON ok.feed = sz.feed GROUP BY 1, 2)
             SELECT *, round(CASE WHEN ips = 0 THEN 0 WHEN samples = 0 THEN 100 WHEN max_common >= ips THEN 0 ELSE 100.0::double * (ips - max_common) / ips END, 4) AS percent FROM m""")
    register("cadence_floor", lambda s, d: f.cadence_floor(h.sizes(b.snapshots(s, d))),
             f"WITH {RUNS}, g AS (SELECT feed, list_sort(list(gap)) AS s FROM (SELECT feed, ts - lag(ts) OVER (PARTITION BY feed ORDER BY ts) AS gap FROM hist) q WHERE gap > 0 GROUP BY feed) SELECT feed, s[len(s) // 2 + 1] AS seconds FROM g")
    register("activity_buckets", lambda s, d: f.activity(h.sizes(b.snapshots(s, d)), h.changesets(b.snapshots(s, d)), 7 * 86400, above=10).select("feed", "ts", F.round("ips", 4).alias("ips"), "added", "removed", F.round("churn", 4).alias("churn")),
             f"""WITH {RUNS}, j AS (SELECT c.*, unique_ips, count(*) OVER (PARTITION BY c.feed) AS n FROM chg c JOIN hist ON hist.feed = c.feed AND hist.ts = c.ts),
             k AS (SELECT feed, CASE WHEN n > 10 THEN (ts + 62135596800) // 604800 * 604800 - 62135596800 ELSE ts END AS ts, added, removed, unique_ips FROM j),
             a AS (SELECT feed, ts, avg(unique_ips) AS ips, CAST(sum(added) AS bigint) AS added, CAST(sum(removed) AS bigint) AS removed FROM k GROUP BY 1, 2)
             SELECT feed, ts, round(ips, 4) AS ips, added, removed, round(100.0::double * (added + removed) / ips, 4) AS churn FROM a""")
