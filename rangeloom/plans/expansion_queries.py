"""Queries over catalogs with derived feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeloom.operators import expansion as ex
from rangeloom.operators import feeds as f
from rangeloom.operators import intervals as iv
from rangeloom.plans import bindings as b
from rangeloom.plans.catalog_queries import HEALTH
from rangeloom.plans.interval_queries import PAIRS

K = "(SELECT CAST(s_suppkey AS bigint) AS k FROM supplier) q"
SOURCES = f"SELECT concat('s', CAST(k AS string)) AS feed, 30 * (k % 5) AS frequency_mins, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 11 <> 0 END AS redistributable, CASE k % 6 WHEN 0 THEN array(1440, 90) WHEN 1 THEN array(10080, 2160) ELSE array(0) END AS history, k % 9 = 0 AS reference FROM {K} WHERE k % 3 > 0"
MERGES = f"SELECT concat('s', CAST(k AS string)) AS feed, array(concat('s', CAST(k - 1 AS string)), concat(' s', CAST(k - 2 AS string)), '') AS sources, CASE WHEN k % 2 = 0 AND k > 6 THEN array(concat('s', CAST(k - 4 AS string))) END AS exclude, CASE WHEN k % 5 = 0 THEN 15 ELSE 0 END AS frequency_mins, CAST(NULL AS boolean) AS redistributable, CASE k % 4 WHEN 0 THEN array(180) END AS history FROM {K} WHERE k % 3 = 0"
BROKEN = f"""SELECT concat('s', CAST(CASE WHEN k = 6 THEN 4 ELSE k END AS string)) AS feed, CASE k % 5 WHEN 0 THEN array('') WHEN 1 THEN array('s1', 's1') WHEN 2 THEN array('s2', 'nowhere') WHEN 3 THEN array(concat('s', CAST(k AS string))) ELSE array('s1', 's2') END AS sources,
  CASE WHEN k % 5 = 4 THEN array('s2') END AS exclude, 0 AS frequency_mins, true AS redistributable, CAST(NULL AS array<int>) AS history FROM {K} WHERE k % 3 = 0"""


def duck(sql: str) -> str:
    """The same text with DuckDB's lists."""
    return sql.replace("array(", "list_value(").replace("array<int>", "integer[]")


LABEL = "CASE WHEN m < 1440 THEN concat('_', m // 60, 'h') WHEN m % 1440 = 0 THEN concat('_', m // 1440, 'd') ELSE concat('_', m // 1440, 'd', m % 1440 // 60, 'h') END"
EXPANDED = f"""s AS ({duck(SOURCES)}), m AS (SELECT feed, list_filter(list_transform(sources, lambda x: trim(x)), lambda x: x <> '') AS plus, coalesce(exclude, CAST([] AS varchar[])) AS minus, frequency_mins, history FROM ({duck(MERGES)}) q0),
w AS (SELECT feed AS parent, unnest(history) AS m FROM s WHERE NOT reference UNION ALL SELECT feed, unnest(history) FROM m),
c AS (SELECT feed, 'primary' AS provenance, frequency_mins, redistributable, CAST([] AS varchar[]) AS plus, CAST([] AS varchar[]) AS minus, CAST(NULL AS integer) AS window_mins FROM s UNION ALL SELECT feed, 'secondary_merge', CASE WHEN frequency_mins > 0 THEN frequency_mins ELSE 60 END, NULL, plus, minus, NULL FROM m
  UNION ALL SELECT concat(parent, {LABEL}), 'secondary_retention', 0, (SELECT redistributable FROM s WHERE s.feed = parent), [parent], CAST([] AS varchar[]), m FROM w WHERE m > 0),
e AS (SELECT feed, unnest(list_concat(plus, minus)) AS parent FROM c), reach(feed, ancestor) AS (SELECT feed, parent FROM e UNION SELECT r.feed, e.parent FROM reach r JOIN e ON e.feed = r.ancestor), barred AS (SELECT feed FROM c WHERE redistributable = false)"""


def _expanded(s, d):
    return ex.expanded(b.bound(s, d, SOURCES, "supplier"), b.bound(s, d, MERGES, "supplier"))


def register_all(register) -> None:
    register("expanded_catalog", lambda s, d: _expanded(s, d).select("feed", "provenance", "frequency_mins", "redistributable", F.array_join("additive", ",").alias("additive"), F.array_join("subtracted", ",").alias("subtracted"), F.coalesce("window_mins", F.lit(0)).alias("window_mins")),
             f"""WITH RECURSIVE {EXPANDED} SELECT feed, provenance, CAST(frequency_mins AS bigint) AS frequency_mins, feed NOT IN (SELECT feed FROM barred) AND feed NOT IN (SELECT reach.feed FROM reach JOIN barred ON barred.feed = ancestor) AS redistributable,
             array_to_string(plus, ',') AS additive, array_to_string(minus, ',') AS subtracted, CAST(coalesce(window_mins, 0) AS bigint) AS window_mins FROM c""")
    register("catalog_problems", lambda s, d: ex.problems(b.bound(s, d, SOURCES, "supplier").unionByName(s.sql("SELECT 'table' AS feed, 30L AS frequency_mins, true AS redistributable, array(60) AS history, true AS reference")), b.bound(s, d, BROKEN, "supplier")),
             f"""WITH s AS ({duck(SOURCES)}), m AS (SELECT feed, list_filter(sources, lambda x: x <> '') AS plus, coalesce(exclude, []) AS minus FROM ({duck(BROKEN)}) q0), w AS (SELECT feed AS parent, unnest(history) AS m FROM s WHERE NOT reference),
             n AS (SELECT feed FROM s UNION ALL SELECT 'table' UNION ALL SELECT feed FROM m UNION ALL SELECT concat(parent, {LABEL}) FROM w WHERE m > 0), e AS (SELECT feed, unnest(list_concat(plus, minus)) AS parent FROM m)
             SELECT feed, 'name made twice' AS problem FROM n GROUP BY feed HAVING count(*) > 1 UNION ALL SELECT feed, 'no sources' FROM m WHERE len(plus) = 0 UNION ALL SELECT feed, 'name listed twice' FROM m WHERE len(plus) <> len(list_distinct(plus))
             UNION ALL SELECT feed, 'name on both sides' FROM m WHERE list_has_any(plus, minus) UNION ALL SELECT DISTINCT feed, 'unknown name' FROM e WHERE parent NOT IN (SELECT feed FROM n) UNION ALL SELECT feed, 'windows of no set' FROM s WHERE reference AND len(history) > 0
             UNION ALL SELECT 'table', 'windows of no set' UNION ALL SELECT DISTINCT feed, 'cycle' FROM e WHERE parent = feed""")
    states = f"SELECT concat('s', CAST(k AS string)) AS feed, k % 7 <> 0 AS enabled, CASE k % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'unmaintained' WHEN 2 THEN 'unavailable' ELSE 'healthy' END AS health FROM {K} WHERE k % 13 <> 0"
    register("merge_compositions", lambda s, d: ex.compositions(_expanded(s, d), b.bound(s, d, states, "supplier")),
             f"""WITH RECURSIVE {EXPANDED}, i AS (SELECT feed, unnest(plus) AS input, 'include' AS role FROM m UNION ALL SELECT feed, unnest(minus), 'exclude' FROM m)
             SELECT i.feed, input, role, CASE WHEN t.feed IS NULL OR NOT enabled OR (role = 'include' AND health IN ('archived', 'unmaintained')) OR (role = 'exclude' AND health IN ('archived', 'unavailable')) THEN 'excluded' WHEN role = 'include' THEN 'included' ELSE 'subtracted' END AS part
             FROM i LEFT JOIN ({states}) t ON t.feed = input""")
    entries = f"SELECT concat('s', CAST(k AS string)) AS feed, CASE WHEN k % 8 = 0 THEN 0 ELSE 17 * (k % 90) END AS frequency_mins, CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN -3 ELSE 1700000000 - k * 977 END AS checked_date, CASE WHEN k % 3 = 0 THEN k % 4 ELSE 0 END AS failures, k % 10 = 0 AS unmaintained, k % 17 = 0 AS archived FROM {K}"
    doubled = " ".join(f"WHEN failures > {n} AND base * {1 << n - 1} >= {f.RETRY_CAP} THEN {f.RETRY_CAP} WHEN failures > {n} AND base * {1 << n} >= every THEN every" for n in range(1, 5))
    register("next_due", lambda s, d: ex.next_due(b.bound(s, d, entries, "supplier"), F.lit(1_700_000_000)),
             f"""WITH e AS (SELECT *, greatest(frequency_mins, 1) AS every, CAST(ceil(greatest(frequency_mins, 1) / 16) AS bigint) AS base FROM ({entries}) q0), r AS (SELECT *, CASE WHEN failures = 0 THEN every + CASE WHEN every <= 30 THEN 0 ELSE least((every + 50) // 100, 10) END
               WHEN unmaintained THEN least(base * pow(2, failures - 1), {f.RETRY_CAP}) ELSE CASE {doubled} ELSE least(base * pow(2, failures - 1), every, {f.RETRY_CAP}) END END AS wait FROM e),
             t AS (SELECT *, CAST(checked_date + wait * 60 AS bigint) AS due_at, CASE WHEN archived THEN 'archived' WHEN frequency_mins = 0 AND checked_date <> 0 THEN 'static' WHEN checked_date <= 0 THEN 'never checked' WHEN 1700000000 < checked_date + wait * 60 THEN CASE WHEN failures > 0 THEN 'retry' ELSE 'waiting' END
               ELSE CASE WHEN failures > 0 THEN 'retry due' ELSE 'due' END END AS state FROM r) SELECT feed, CAST(CASE WHEN state IN ('archived', 'static') THEN 1700000000 + {ex.FAR_MINS * 60} WHEN state IN ('retry', 'waiting') THEN due_at ELSE 1700000000 END AS bigint) AS due, state FROM t""")
    shown = lambda s, d: f.health(b.catalog(s, d)).withColumns({"hidden": F.expr("feed_no % 10 = 0"), "reference": F.expr("feed_no % 15 = 1"), "redistributable": F.expr("CASE WHEN feed_no % 3 = 0 THEN feed_no % 2 = 0 END")})
    flags = "feed_no % 10 = 0 AS hidden, feed_no % 15 = 1 AS reference, CASE WHEN feed_no % 3 = 0 THEN feed_no % 2 = 0 END AS redistributable"
    register("downloadable_feeds", lambda s, d: ex.downloadable(shown(s, d)).select("feed"), f"WITH {HEALTH}, x AS (SELECT *, {flags} FROM hl) SELECT feed FROM x WHERE NOT hidden AND NOT reference AND coalesce(redistributable, true) AND health <> 'archived'")
    wanted = "SELECT concat('Supplier#', CAST(s_suppkey AS string)) AS feed FROM supplier UNION ALL SELECT s_name FROM supplier"
    register("barred_from_composition", lambda s, d: ex.composable(shown(s, d), b.bound(s, d, wanted, "supplier")),
             f"""WITH {HEALTH}, x AS (SELECT *, {flags} FROM hl), r AS (SELECT DISTINCT w.feed, CASE WHEN x.feed IS NULL OR hidden OR reference THEN 'unknown' WHEN NOT coalesce(redistributable, true) THEN 'not redistributable' WHEN health = 'archived' THEN 'archived' END AS reason FROM ({wanted}) w LEFT JOIN x ON x.feed = w.feed)
             SELECT * FROM r WHERE reason IS NOT NULL""")
    register("filter_options", lambda s, d: ex.filter_options(shown(s, d), "category", "health", "maintainer"),
             f"""WITH {HEALTH}, o AS (SELECT DISTINCT 'category' AS filter, category AS value FROM hl UNION SELECT DISTINCT 'health', health FROM hl UNION SELECT DISTINCT 'maintainer', maintainer FROM hl WHERE maintainer <> '')
             SELECT filter, CAST(row_number() OVER (PARTITION BY filter ORDER BY value) AS integer) AS place, value FROM o""")
    first = "feed_RF"
    register("compare_on_demand", lambda s, d: iv.compare_first(iv.optimize(b.ranges_raw(s, d)), first).orderBy(F.desc("common"), "name").select("name", "common"),
             f"{PAIRS} SELECT CASE WHEN name1 = '{first}' THEN name2 ELSE name1 END AS name, common FROM pairs WHERE '{first}' IN (name1, name2)")
